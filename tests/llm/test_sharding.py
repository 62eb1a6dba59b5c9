import hashlib
import random
from collections import Counter, defaultdict

import pyarrow.dataset as ds
import pytest
from cloudloom.llm import sharding


def bits(key):
    return f"{int(hashlib.md5(('' if key is None else str(key)).encode()).hexdigest()[:15], 16):060b}"


def plain_shards(rows, limit):
    """Split oversized prefixes one bit at a time."""
    sizes, todo, out = [(bits(k), len((t or "").encode())) for k, t in rows], [""], {}
    while todo:
        p = todo.pop()
        mine = [i for i, (b, _) in enumerate(sizes) if b.startswith(p)]
        if mine and (sum(sizes[i][1] for i in mine) <= limit or len(mine) == 1):
            out.update(dict.fromkeys(mine, p))
        elif mine:
            todo += [p + "0", p + "1"]
    return [out[i] for i in range(len(rows))]


@pytest.mark.parametrize("limit", [1 << 24, 20_000, 3_000, 120])
def test_prefixes_are_those_of_one_bit_splits(spark, limit):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randrange(60)) for i in range(400)] + [(None, "x"), (900, None), (901, ""), (902, "y" * 5000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, shard string")
    got = sharding.assign_shards(df, limit).collect()
    want = Counter((k, len((t or "").encode()), "s" + s) for (k, t), s in zip(rows, plain_shards(rows, limit), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.shard) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.shard].append(r.n_bytes)
        assert r.depth == len(r.shard) - 1
    for r in got:
        assert (r.shard_bytes, r.shard_docs) == (sum(held[r.shard]), len(held[r.shard])) and (r.shard_bytes <= limit or r.shard_docs == 1)


def test_repeated_keys_split_by_row(spark):
    rows = [(7, "a" * 50)] * 300 + [(i, "b" * 10) for i in range(100)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect()
    assert len(got) == 400 and all(r.shard_bytes <= 400 for r in got) and len({r.row for r in got}) == 400
    assert len({r.shard for r in got if r.doc_id == 7}) >= 38


def test_no_two_shards_overlap(spark):
    got = {r.shard for r in sharding.assign_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 100_000).collect()}
    assert len(got) > 20 and not any(a != b and b.startswith(a) for a in got for b in got)


def test_written_shards_hold_all_rows(spark, tmp_path):
    df = spark.createDataFrame([(i % 40, "t" * i) for i in range(90)], "doc_id long, text string")
    sharding.write_shards(df, f"{tmp_path}/out", 500)
    back = ds.dataset(f"{tmp_path}/out", partitioning="hive").to_table().to_pylist()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted((i % 40, "t" * i) for i in range(90))
    size = Counter()
    for r in back:
        size[r["shard"]] += len(r["text"])
    assert max(size.values()) <= 500


def test_empty_table(spark):
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []
