"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when their normal forms are, here those without white space. A
map task chains equal texts of its own rows, comparing bytes under a 64-bit key,
and writes one entry for each distinct text: its bytes, its key and the ids of
its rows. These entries in the shared folder are the index. So a text with any
number of copies is an entry a task at most, and its copies go nowhere.

The directory is indexed by the key's first bits. It starts with one bucket and
doubles; only buckets over their byte limit split on another bit. A bucket is a
range of keys and has one owner task, which gets the entries in order of keys and
chains those of a key: each is compared with the chain's texts byte by byte and
joins its equal, or extends the chain. The owner names each text's row that
stays, entries get it back by their numbers, and their rows follow.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm.columns import quoted, whole_row
from cloudloom.llm.memory import give_back
from cloudloom.workspace import materialise, new_path

#: Fixed: the bytes that normal forms lack.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of distinct texts and rows that a map task chains before it writes its entries; bytes sent on at a time.
HELD, ROWS_HELD, SENT = 32 << 20, 500_000, 4 << 20
#: A bucket's bytes from which it splits, the directory's bits at most (then buckets grow), bytes an owner takes in.
BUCKET, DIRECTORY_BITS, OWNED = 8 << 20, 18, 64 << 20
ENTRY = "entry long, key long, n_bytes long, n long, at long, size long, id long, ids array<long>, numbers array<long>, sha256 binary, text binary"
KEPT = "entry long, keep_id long, group_size long, won boolean"

Hash = Callable[[bytes], int]


class Chains:
    """Equal texts of a task's rows: by key, a chain of the distinct texts that have it."""

    def __init__(self, hashed: Hash, most: int) -> None:
        self.hashed, self.most, self.done = hashed, most, 0
        self.clear()

    def clear(self) -> None:
        self.by_key: dict[int, list[int]] = {}
        self.texts: list[bytes] = []
        self.keys: list[int] = []
        self.ids: list[list[int | None]] = []
        self.numbers: list[list[int]] = []
        self.best: list[tuple[tuple[int, bool, int], int]] = []
        self.held = self.rows = 0

    def add(self, number: int, id_: int | None, text: bytes, size: int) -> None:
        key = self.hashed(text)
        chain = self.by_key.setdefault(key, [])
        rank = (-size, id_ is None, id_ or 0)
        self.rows += 1
        for i in chain:
            if self.texts[i] == text:
                if rank < self.best[i][0]:
                    self.best[i] = rank, len(self.ids[i])
                self.ids[i].append(id_)
                self.numbers[i].append(number)
                return
        chain.append(len(self.texts))
        self.texts.append(text)
        self.keys.append(key)
        self.ids.append([id_])
        self.numbers.append([number])
        self.best.append((rank, 0))
        self.held += len(text)

    def full(self) -> bool:
        return self.held >= self.most or self.rows >= ROWS_HELD

    def entries(self, part: int) -> Iterator[pa.RecordBatch]:
        """The chained texts as rows of the index; nothing is held afterwards."""
        names = [f.split()[0] for f in ENTRY.split(", ")]
        start = 0
        while start < len(self.texts):
            stop, sent = start, 0
            while stop < len(self.texts) and (stop == start or sent < SENT):
                sent += len(self.texts[stop]) + 16 * len(self.ids[stop])
                stop += 1
            rows = range(start, stop)
            number = np.arange(self.done, self.done + stop - start) + (part << 33)
            best = [self.best[i] for i in rows]
            columns = [
                pa.array(number),
                pa.array(np.array(self.keys[start:stop], np.uint64).view(np.int64)),
                pa.array([len(self.texts[i]) for i in rows], pa.int64()),
                pa.array([len(self.ids[i]) for i in rows], pa.int64()),
                pa.array([at for _, at in best], pa.int64()),
                pa.array([-rank[0] for rank, _ in best], pa.int64()),
                pa.array([None if rank[1] else rank[2] for rank, _ in best], pa.int64()),
                pa.array(self.ids[start:stop], pa.list_(pa.int64())),
                pa.array(self.numbers[start:stop], pa.list_(pa.int64())),
                pa.array([hashlib.sha256(self.texts[i]).digest() for i in rows], pa.binary()),
                pa.array(self.texts[start:stop], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
            self.done, start = self.done + stop - start, stop
        self.clear()


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, hashed: Hash = xxhash.xxh3_64_intdigest, held: int = HELD) -> DataFrame:
    """Write the index's entries (ENTRY) of all rows to ``path`` on shared files, and return them.

    ``size`` and ``id`` are those of the entry's row that stays, ``at`` its place in ``ids``
    and ``numbers``, which are the rows' ids and their numbers (``row_col``, if the table has one).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chains = TaskContext.get().partitionId(), Chains(hashed, held)
        for b in batches:
            for number, id_, text, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                chains.add(number, id_, text.as_py().translate(None, BLANKS), size)
                if chains.full():
                    yield from chains.entries(part)
        yield from chains.entries(part)
        give_back()

    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    number = quoted(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(number.alias("number"), quoted(id_col).cast("long").alias("id"), text.cast("binary").alias("text"), F.length(text).cast("long").alias("size"))
    rows.mapInArrow(run, ENTRY).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(ENTRY).parquet(path)


def split_depths(cells: np.ndarray, limit: int) -> np.ndarray:
    """How many bits each cell's bucket has, for the bytes in the cells of a full directory.

    The directory doubles as long as one of its buckets is over the limit; such buckets alone split.
    """
    depths = np.zeros(len(cells), np.int32)
    for depth in range(int(math.log2(len(cells)))):
        over = cells.reshape(1 << depth, -1).sum(1) > limit
        if not over.any():
            break
        depths[np.repeat(over, len(cells) >> depth) & (depths == depth)] = depth + 1
    return depths


def directory(entries: DataFrame, limit: int = BUCKET) -> tuple[DataFrame, int, int]:
    """``(cell, bucket, depth)`` rows for a key's first bits, their number, and all bytes; at most 2^DIRECTORY_BITS rows."""
    total = entries.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first().b
    bits = min(DIRECTORY_BITS, max(1, math.ceil(math.log2(max(1, total) / limit)) + 4)) if total > limit else 1
    sums = entries.groupBy(cell_of(bits).alias("cell")).agg(F.sum("n_bytes").alias("b")).collect()
    cells = np.zeros(1 << bits, np.int64)
    cells[[r.cell for r in sums]] = [r.b for r in sums]
    depths = split_depths(cells, limit)
    first = (np.arange(len(cells)) >> (bits - depths)) << (bits - depths)  # a bucket is named by its first cell
    rows = list(zip(range(len(cells)), first.tolist(), depths.tolist(), strict=True))
    return entries.sparkSession.createDataFrame(rows, "cell long, bucket long, depth int"), bits, total


def cell_of(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits)


def owned(entries: DataFrame, limit: int = BUCKET) -> DataFrame:
    """``(entry, keep_id, group_size, won)``: each entry's row that stays, the rows of all its equals, and whether it holds that row itself."""
    names = ["key", "entry", "n", "size", "id", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain = None, []  # of a text: bytes, entries, rows, rank of the best row
        out: list[tuple] = []

        def close() -> None:
            for _, found, n, best in chain:
                out.extend((e, None if best[1] else best[2], n, e == best[3]) for e in found)

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["entry", "keep_id", "group_size", "won"])
            out.clear()
            return batch

        for b in batches:
            texts = b.column(5)
            for i, (k, entry, n, size, id_) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)), strict=True)):
                if k != key:
                    close()
                    key, chain = k, []
                    if len(out) > 10_000:
                        yield sent()
                text, rank = texts[i].as_py(), (-size, id_ is None, id_ or 0, entry)
                for link in chain:
                    if link[0] == text:
                        link[1].append(entry)
                        link[2] += n
                        link[3] = min(link[3], rank)
                        break
                else:
                    chain.append([text, [entry], n, rank])
        close()
        if out:
            yield sent()
        give_back()

    cells, bits, total = directory(entries, limit)
    placed = entries.withColumn("cell", cell_of(bits)).join(F.broadcast(cells), "cell").select("bucket", *names)
    tasks = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // OWNED) + 1)
    return placed.repartition(tasks, "bucket").sortWithinPartitions("bucket", "key", "entry").select(*names).mapInArrow(run, KEPT)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, hashed: Hash = xxhash.xxh3_64_intdigest, limit: int = BUCKET, held: int = HELD) -> DataFrame:
    """``(row, doc_id, keep_id, group_size, kept, sha256)`` for every row of ``docs``.

    Of rows with equal texts but for white space the one with the longest original
    text stays, then that of the smallest id, null ids last, then any one. Null texts
    are like empty and blank ones, equal to each other. Repeated rows are copies.
    ``row`` is a number of the row (``row_col``, if the table has one). Other columns
    are ignored, an empty table gives an empty table.
    """
    entries = write_index(docs, new_path(docs.sparkSession, "exact-index"), id_col, text_col, row_col, hashed, held)
    named = entries.select("entry", "at", "sha256", F.arrays_zip("numbers", "ids").alias("rows")).join(owned(entries, limit), "entry")
    rows = named.select("keep_id", "group_size", "won", "at", "sha256", F.posexplode("rows").alias("place", "r"))
    return rows.select(F.col("r.numbers").alias("row"), F.col("r.ids").alias("doc_id"), "keep_id", "group_size", (F.col("won") & (F.col("place") == F.col("at"))).alias("kept"), "sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns."""
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), whole_row(docs).alias("own")), "rows")
    slim = rows.select("row", F.col("own")[id_col].alias("id"), F.col("own")[text_col].alias("text"))
    stay = exact_groups(slim, "id", "text", "row").where("kept").select("row")
    return rows.join(stay, "row", "left_semi").select("own.*")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays of its group of equal texts."""
    found = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW best AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST)
"""
