"""Ranked lexical search by a two-level quantised index, exact to the last integer.

A term's part in a score is its weight times its impact in the document, a whole
number below a million that saturates with its occurrences and falls with the
document's length. The index has a document's terms (those that queries ask for)
at two levels: impacts rounded up to a byte, and exact occurrences. Sums of
weights and bytes are upper bounds of scores, and lie above them by at most one
byte's step for each of the query's terms, so they are lower bounds as well.

Documents are scored in blocks. All of a block get their upper bounds from the
bytes; those whose bound reaches the k-th best lower bound (or the k-th best
score so far) are scored anew from the exact level, in whole numbers. A task
keeps its k best of each item, ties by id, so what leaves it grows with items and
tasks alone, and the k best of these are the result.

Items are taken ``PAIRS`` (item, term) pairs at a time, as many passes as it
takes: terms, weights and items of a pass are broadcast, documents never are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm.columns import quoted
from cloudloom.llm.memory import give_back
from cloudloom.llm.words import LOWER
from cloudloom.workspace import materialise

#: Fixed: terms are runs of ASCII letters and digits and of all other characters beyond ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Fixed: what an impact is made of.
SCALE, TF_SCALE, LENGTH_SCALE, BASE, SLOPE, LOG_SCALE = 1_000_000_000, 1000, 8, 10, 90, 1000
#: A byte's step: 255 of them cover every impact.
STEP = -(-SCALE // TF_SCALE // 255)
#: Pairs of items and terms a pass, documents scored at a time, postings from this share of a block on laid out as a row.
PAIRS, BLOCK, DENSE = 1 << 17, 4096, 8
COUNTS = "doc_id long, n long, ids array<int>, tfs array<int>"
INDEX = "doc_id long, m long, ids array<int>, impacts binary, tfs array<int>"
FOUND = "item long, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    """The terms of UTF-8 text in order; A-Z alone are lower-cased."""
    return TERM.findall(text.translate(LOWER))


def _lists(flat: np.ndarray, sizes: list[int]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _counted(batches: Iterator[pa.RecordBatch], known: Broadcast) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, ids, tfs) of documents with terms: how many, and which of the known ones how often."""
    number = known.value
    for b in batches:
        rows, sizes, ids, tfs = [], [], [], []
        for row, text in enumerate(b.column(1)):
            found = terms(text.as_py())
            if found:
                hits = [(number[t], f) for t, f in Counter(found).items() if t in number]
                rows.append((row, len(found)))
                sizes.append(len(hits))
                ids.extend(h[0] for h in hits)
                tfs.extend(h[1] for h in hits)
        if rows:
            at, n = np.array(rows, np.int64).T
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(n), _lists(np.array(ids, np.int32), sizes), _lists(np.array(tfs, np.int32), sizes)], ["doc_id", "n", "ids", "tfs"])
    give_back()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (TF_SCALE * tf + LENGTH_SCALE * m)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a column of lists."""
    return np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))


def _quantised(batches: Iterator[pa.RecordBatch], docs: int, length: int) -> Iterator[pa.RecordBatch]:
    """The index's rows, from counts and the corpus's size."""
    for b in batches:
        m = BASE + SLOPE * np.asarray(b.column(1)) * docs // length
        tf, sizes = _flat(b.column(3))
        bytes_ = -(-impacts(tf.astype(np.int64), np.repeat(m, sizes)) // STEP)
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(bytes_.astype(np.uint8).tobytes())])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m), b.column(2), packed, b.column(3)], ["doc_id", "m", "ids", "impacts", "tfs"])


class Asked:
    """The items of a pass: their terms' numbers, and every number's weight."""

    def __init__(self, items: list[int], terms_of: list[np.ndarray], weight: np.ndarray) -> None:
        self.items, self.terms_of, self.weight = items, terms_of, weight
        self.slack = [int(weight[t].sum()) for t in terms_of]


class Best:
    """An item's ``k`` best documents so far."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id, self.none = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def least(self) -> int:
        """A score below this can't enter any more."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, id_: np.ndarray, none: np.ndarray) -> None:
        score, id_, none = (np.concatenate(x) for x in ((self.score, score), (self.id, id_), (self.none, none)))
        order = np.lexsort((id_, none, -score))[: self.k]
        self.score, self.id, self.none = score[order], id_[order], none[order]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        for at in range(0, len(b), BLOCK):
            held.append(b.slice(at, BLOCK))
            if sum(map(len, held)) >= BLOCK:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def _searched(batches: Iterator[pa.RecordBatch], asked: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    """Each item's ``k`` best documents of a task."""
    a: Asked = asked.value
    best = [Best(k) for _ in a.items]
    member = np.zeros(len(a.weight), bool)
    for b in _blocks(batches):
        rows = len(b)
        none = np.asarray(b.column(0).is_null())
        doc, m = np.asarray(b.column(0).fill_null(0)), np.asarray(b.column(1))
        (ids, sizes), (tfs, _) = _flat(b.column(2)), _flat(b.column(4))
        bytes_ = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        order = np.argsort(ids, kind="stable")
        by_term, row_of = ids[order], np.repeat(np.arange(rows), sizes)[order]
        bound = a.weight[by_term] * bytes_[order]
        first = np.searchsorted(by_term, np.arange(len(a.weight) + 1))
        laid: dict[int, np.ndarray] = {}
        for item, wanted in enumerate(a.terms_of):
            total = np.zeros(rows, np.int64)
            for t in wanted.tolist():
                s, e = first[t], first[t + 1]
                if (e - s) * DENSE < rows:
                    total[row_of[s:e]] += bound[s:e]
                else:
                    if t not in laid:
                        laid[t] = np.zeros(rows, np.int64)
                        laid[t][row_of[s:e]] = bound[s:e]
                    total += laid[t]
            # a sum is above the exact score by at most one step a term
            low = int(np.partition(total, rows - k)[rows - k]) - a.slack[item] if rows >= k else 0
            rise = np.flatnonzero(total * STEP >= max(best[item].least(), low * STEP))
            if len(rise):
                member[wanted] = True
                score = _exact(rise, starts, ids, tfs, m, member, a.weight)
                member[wanted] = False
                some = score > 0
                best[item].add(score[some], doc[rise[some]], none[rise[some]])
    for item, found in zip(a.items, best, strict=True):
        if len(found.score):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.score), item)), pa.array(found.id, mask=found.none), pa.array(found.score)], ["item", "doc_id", "score"])
    give_back()


def _exact(rows: np.ndarray, starts: np.ndarray, ids: np.ndarray, tfs: np.ndarray, m: np.ndarray, member: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Exact scores of rows, of their terms that are members."""
    out = np.zeros(len(rows), np.int64)
    for i in range(0, len(rows), 512):
        part = rows[i : i + 512]
        sizes = starts[part + 1] - starts[part]
        of = np.repeat(np.arange(len(part)), sizes)
        at = np.arange(sizes.sum()) + np.repeat(starts[part] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        hit = member[ids[at]]
        at, of = at[hit], of[hit]
        np.add.at(out, of + i, weight[ids[at]] * impacts(tfs[at].astype(np.int64), m[part[of]]))
    return out


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    """Terms' weights by how many of the documents hold them."""
    return np.array([math.floor(LOG_SCALE * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def build_index(docs: DataFrame, known: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """The two-level index of all ``docs`` with terms, on shared files, for the known terms (bytes to number); and their weights."""
    spark = docs.sparkSession
    rows = docs.where(quoted(text_col).isNotNull()).select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").cast("binary").alias("text"))
    counts = materialise(rows.mapInArrow(lambda batches: _counted(batches, known), COUNTS), "counts")
    corpus = counts.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    held = np.zeros(len(known.value), np.int64)
    for r in counts.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).toLocalIterator():
        held[r.id] = r.df
    index = counts.mapInArrow(lambda batches: _quantised(batches, corpus.docs, max(1, corpus.length)), INDEX)
    return materialise(index, "index"), weights(held, corpus.docs)


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", pairs: int = PAIRS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` highest-scoring rows of ``docs`` for each row of ``items``.

    Scores are above 0; equal ones by ascending id, null ids last, then in any
    order. Null and empty texts have no terms: such items find nothing, such
    documents count nowhere. Repeated rows are documents and items of their own.
    Other columns are ignored, empty tables give an empty table.
    """
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms(t.as_py()))) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.binary()))], ["item", "item_id", "terms"])

    named = quoted(item_col)
    rows = items.where(quoted(item_text).isNotNull()).select(F.monotonically_increasing_id().alias("item"), named.alias("item_id"), quoted(item_text).cast("string").cast("binary").alias("text"))
    schema = rows.select("item", "item_id").schema.add("terms", T.ArrayType(T.BinaryType()))
    asked = materialise(rows.mapInArrow(cut, schema).where(F.size("terms") > 0), "items")
    passes = (asked.agg(F.sum(F.size("terms")).alias("n")).first().n or 0) // pairs + 1
    found = None
    for p in range(passes):  # a pass has about ``pairs`` pairs, or one item more
        part = [(r.item, [bytes(t) for t in r.terms]) for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).collect()]
        number = {t: i for i, t in enumerate(sorted({t for _, ts in part for t in ts}))}
        known = spark.sparkContext.broadcast(number)
        index, weight = build_index(docs, known, id_col, text_col)
        plan = spark.sparkContext.broadcast(Asked([i for i, _ in part], [np.array([number[t] for t in ts], np.int64) for _, ts in part], weight))
        one = index.mapInArrow(lambda batches, plan=plan: _searched(batches, plan, k), FOUND)
        found = one if found is None else found.union(one)
    ordered = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for each item of ``benchmark``."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (
  SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts FROM benchmark),
c AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS length FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d),
f AS (SELECT r, doc_id, n, t, count(*) AS tf FROM p GROUP BY 1, 2, 3, 4),
w AS (SELECT t, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY 1),
a AS (SELECT i, item_id, unnest(ts) AS t FROM q),
s AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // length))))) AS BIGINT) AS score
  FROM a JOIN w USING (t) JOIN f USING (t), c GROUP BY 1, 2, 3, 4)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
