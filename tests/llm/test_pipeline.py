import hashlib
import random

import corpus_pipeline
import pyarrow.parquet as pq
import pytest
import tiktoken
from cloudloom.llm import bpe, quality, simhash
from cloudloom.llm.words import lower_words, shingles
from cloudloom.workspace import materialise


def prose(rng, n):
    """Words like those of the test documents, with a full stop now and then."""
    parts = ["th", "er", "on", "an", "re", "ti", "es", "ou", "en", "st"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "", "", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def made(tmp_path_factory, spark):
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(60, 300)) for _ in range(40)]
    items = [prose(rng, n) for n in (16, 30, 55)]
    rows, group = [], {}
    add = lambda t, g: (group.setdefault(len(rows), g), rows.append((len(rows), t, "en", "s", len(t or ""), "x")))
    for i, t in enumerate(base):
        add(t, ("copy", i))
        for _ in range(rng.randrange(3)):
            w = t.split()
            w[rng.randrange(len(w))] = "altered"
            add(" ".join(w), ("copy", i))
    for i in range(3):
        add(f"{prose(rng, 80)} {items[i]} {prose(rng, 80)}", "leak")
    add("Write to some.one@mail.example.org or +1 (212) 555-0100. " + prose(rng, 60), "pii")
    for _ in range(6):
        add(" ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in prose(rng, 120).split()), "junk")
        add(" | ".join(prose(rng, 60).split()), "junk")
    for t in (None, "", " \n"):
        add(t, "none")
    sf = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k0 string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return str(sf), rows, group


def test_stages_do_what_plain_versions_do(spark, made):
    sf, rows, group = made
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), name)
        seen[name] = docs
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "k0"]
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert ids["quality_rules"] == {i for i, g in group.items() if g not in ("junk", "none")}
    firsts = {}
    for i, g in group.items():
        firsts.setdefault(g, i)
    assert ids["near_dedup"] == {i for i, g in group.items() if g in ("leak", "pii") or firsts[g] == i and g[0] == "copy"}
    assert ids["decontamination"] == {i for i in ids["near_dedup"] if group[i] != "leak"}
    texts = {r.doc_id: r.text for r in seen["pii_redaction"].collect()}
    (private,) = [i for i, g in group.items() if g == "pii"]
    assert texts[private].startswith("Write to [EMAIL] or [PHONE]. ")
    assert all(texts[i] == rows[i][1] for i in texts if i != private)
    import public_tokenizers

    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in seen["byte_bpe"].collect():
        assert r.token_ids == plain.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_equals_its_stages_and_repeats(spark, made):
    sf = made[0]
    first, second = (sorted(map(str, corpus_pipeline.run(spark, sf).collect())) for _ in range(2))
    assert first == second and first


def test_every_stage_takes_empty_tables(spark, made):
    sf = made[0]
    none = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert materialise(stage(spark, none, sf), name).count() == 0


def test_near_copies_follow_jaccard(spark):
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs], "doc_id long, text string")
    root = {r.rid: r.root for r in simhash.near_copies(df, "doc_id").collect()}
    assert len(root) == len(docs)
    sets = {r["doc_id"]: set(shingles(lower_words(r["text"]), 5)) for r in docs if quality.text_stats(r["text"])[0] >= 10}
    like = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and not x.isdisjoint(y)}
    assert all(root[a] == root[b] for (a, b), j in like.items() if j >= 0.8)
    near = {i for k, j in like.items() if j >= 0.7 for i in k}
    assert all(root[i] == i for i in sets if i not in near)
