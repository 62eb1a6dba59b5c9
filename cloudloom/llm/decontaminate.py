"""Benchmark decontamination with SimHash windows of item size.

Benchmark items are few and fixed next to the corpus; they are put into classes
by length, each class with one window size (the items' length, or up to a fifth
less). An item is indexed under the fingerprints of its first and of its last
window. Every document slides windows of each class over its words: running sums
of shingle bits give all fingerprints in a few vector operations. A 64-bit
fingerprint is looked up by its four 16-bit blocks: one within ``RADIUS`` of an
item's has a block within a quarter of the radius of the item's block, so tables
that list, for every block value, the items with a block so near name all
candidates, however many items there are. Before that, tables of every block
value's distance to the nearest item's block turn most windows away while items
are few: four such distances sum to the radius at most. Neither step misses
anything. Fingerprints within the radius are then verified by the exact weighted similarity of the item-sized span: sums of the smaller over sums
of the larger counts of each five-word shingle.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm.columns import quoted
from cloudloom.llm.memory import give_back
from cloudloom.workspace import materialise, release

SHINGLE, RADIUS, SIMILAR = 5, 13, 0.8
BLOCK_BITS = 16
#: All block values within a quarter of the radius of zero.
_BALL = np.flatnonzero(np.bitwise_count(np.arange(1 << BLOCK_BITS, dtype=np.uint16)) <= RADIUS * BLOCK_BITS // 64).astype(np.uint16)
#: Items of one pass over the documents; further items take further passes.
ITEMS_A_PASS = 4096
#: Windows whose bit sums are held at a time, and shingles of texts that are searched together.
STEP, TOGETHER = 16384, 1 << 15
#: Pairs of windows and items' rows that are compared at a time, about.
PAIRS = 1 << 18
_MARKS = string.punctuation.encode()
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def plain_words(text: str | None) -> list[bytes]:
    """Words without case (A-Z) and without ASCII marks at either end; words of marks only go."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and blanks only
    return list(filter(None, map(bytes.strip, words, repeat(_MARKS))))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of all five-word shingles in order, from the hashes of their words; fewer words have none."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    total = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        total = (total ^ (each[j : j + n] * _FACTORS[j])) * _FACTORS[(j + 1) % SHINGLE]
        total ^= total >> np.uint64(29)
    return total


def window_fingerprints(hashes: np.ndarray, spans: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(span, first, fingerprints): SimHash of every run of ``span`` shingles as eight bytes, in pieces of bounded size."""
    longest = max(spans, default=0)
    # sums of several bits lie side by side in a 64-bit number: their differences are exact while a window's fit their lane
    lane = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.uint32
    for at in range(0, len(hashes), STEP):
        part = hashes[at : at + STEP + longest - 1]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8))
        lanes = bits.astype(lane, copy=False).view(np.uint64).reshape(len(part), -1)
        sums = np.zeros((len(part) + 1, lanes.shape[1]), np.uint64)
        np.cumsum(lanes, axis=0, out=sums[1:])  # wraps; differences don't
        for span in spans:
            n = min(STEP, len(part) - span + 1)
            if n > 0:
                ones = (sums[span : span + n] - sums[:n]).view(lane)
                yield span, at, np.packbits((ones > span // 2).ravel()).reshape(-1, 8)


def _blocks(fps: np.ndarray) -> np.ndarray:
    """The 16-bit blocks of fingerprints, a row for each place."""
    return fps.view(np.uint16).reshape(-1, 64 // BLOCK_BITS).T.astype(np.intp)


def _rolled(fps: np.ndarray) -> np.ndarray:
    """Fingerprints turned by a byte, so that their blocks lie across the borders of the others."""
    return fps << np.uint64(8) | fps >> np.uint64(56)


def window_size(n_words: int) -> int:
    """The class of an item: the largest step of a 5/4 ladder that is no longer than it."""
    size = SHINGLE
    while (longer := max(size + 1, size * 5 // 4)) <= n_words:
        size = longer
    return size


class Index:
    """Fingerprints of items by class, in four tables of block values each."""

    def __init__(self, items: list[tuple[object, str]]):
        self.counts: list[Counter] = []
        self.ids, self.lengths = [], []
        at: dict[int, list[tuple[int, int, bool]]] = defaultdict(list)
        for item, text in items:
            hashes = shingle_hashes(plain_words(text))
            if not len(hashes):
                continue
            size, k = window_size(len(hashes) + SHINGLE - 1), len(self.ids)
            span = size - SHINGLE + 1
            for first in {0, len(hashes) - span}:
                for _, _, fp in window_fingerprints(hashes[first : first + span], [span]):
                    at[span].append((int(fp.view(np.uint64)[0, 0]), k, first))
            self.ids.append(item)
            self.lengths.append(len(hashes))
            self.counts.append(Counter(hashes.tolist()))
        self.spans = sorted(at)
        self.rows = {s: (np.array([f for f, _, _ in x], np.uint64), [(k, first) for _, k, first in x]) for s, x in at.items()}
        self.lists = {s: self._lists(fps) for s, (fps, _) in self.rows.items()}
        self.near = {s: (self._tables(fps), self._tables(_rolled(fps))) for s, (fps, _) in self.rows.items()}

    @staticmethod
    def _tables(fps: np.ndarray) -> list[np.ndarray]:
        values = np.arange(1 << BLOCK_BITS, dtype=np.uint16)
        out = []
        for block in _blocks(fps):
            nearest = np.full(len(values), BLOCK_BITS, np.uint8)
            for x in np.unique(block):
                np.minimum(nearest, np.bitwise_count(values ^ np.uint16(x)), out=nearest)
            out.append(nearest)
        return out

    @staticmethod
    def _lists(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block (starts, rows): the rows whose block is within a quarter of the radius of a value, by value."""
        out = []
        for block in _blocks(fps):
            values = (block.astype(np.uint16)[:, None] ^ _BALL).ravel()
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1))
            out.append((starts, (order // len(_BALL)).astype(np.int32)))
        return out

    @staticmethod
    def _least(tables: list[np.ndarray], fps: np.ndarray) -> np.ndarray:
        """A lower bound of every fingerprint's distance to the nearest item."""
        return sum(table.take(block, mode="clip") for table, block in zip(tables, _blocks(fps), strict=True))

    def within(self, span: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, row) of all indexed fingerprints of a class within the radius."""
        first, second = self.near[span]
        whole = fps.view(np.uint64).ravel()
        maybe = np.flatnonzero(self._least(first, whole) <= RADIUS)
        whole = whole.take(maybe)
        # the same test on other blocks: a byte further on
        still = np.flatnonzero(self._least(second, _rolled(whole)) <= RADIUS)
        maybe, whole = maybe.take(still), whole.take(still)
        rows, found = self.rows[span][0], []
        first, size = np.empty((2, 64 // BLOCK_BITS, len(maybe)), np.int64)
        for k, ((starts, _), x) in enumerate(zip(self.lists[span], _blocks(whole), strict=True)):
            first[k], size[k] = starts.take(x), starts.take(x + 1)
        size -= first
        total = np.cumsum(size.sum(0))
        cuts = [0, *(np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)) + 1).tolist(), len(maybe)] if len(maybe) else []
        for a, z in pairwise(cuts):
            for k, (_, of) in enumerate(self.lists[span]):
                n = size[k, a:z]
                stops = np.cumsum(n)
                w = np.repeat(np.arange(a, z), n)
                r = of.take(np.arange(len(w)) + np.repeat(first[k, a:z] - stops + n, n))
                near = np.flatnonzero(np.bitwise_count(whole.take(w) ^ rows.take(r)) <= RADIUS)
                found.append(maybe.take(w.take(near)) * len(rows) + r.take(near))
        both = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return both // max(1, len(rows)), both % max(1, len(rows))

    def leaks(self, texts: Iterable[str | None]) -> Iterator[list[tuple[object, float, int, int]]]:
        """For every text (item, similarity, first word, words) of the best span of each item found in it."""
        waiting: list[np.ndarray] = []
        size = 0
        for text in texts:
            waiting.append(shingle_hashes(plain_words(text)))
            size += len(waiting[-1])
            if size >= TOGETHER:
                yield from self._leaks_of(waiting)
                waiting, size = [], 0
        yield from self._leaks_of(waiting)

    def _leaks_of(self, parts: list[np.ndarray]) -> list[list[tuple[object, float, int, int]]]:
        """``leaks`` of several texts' shingles, laid end to end; windows over a border don't count."""
        if not parts:
            return []
        hashes, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in parts]
        seen: set[tuple[int, int]] = set()
        for span, at, fps in window_fingerprints(hashes, [s for s in self.spans if s <= len(hashes)]):
            for w, r in zip(*(x.tolist() for x in self.within(span, fps)), strict=True):
                doc = int(np.searchsorted(ends, at + w, "right"))
                k, first = self.rows[span][1][r]
                low, high = int(ends[doc]) - len(parts[doc]), int(ends[doc])
                start = max(low, at + w - first)
                stop = min(high, start + self.lengths[k])
                if at + w + span > high or (k, start) in seen:
                    continue
                seen.add((k, start))
                there, item = Counter(hashes[start:stop].tolist()), self.counts[k]
                both = sum(min(n, item[x]) for x, n in there.items() if x in item)
                similar = both / (there.total() + item.total() - both)
                known = best[doc].get(k)
                if similar >= SIMILAR and (known is None or (similar, low - start) > (known[0], -known[1])):
                    best[doc][k] = (similar, start - low, stop - start + SHINGLE - 1)
        return [[(self.ids[k], *found) for k, found in sorted(b.items())] for b in best]


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for every document row and item found in it: ``keep`` (as k0, k1, ...), item_id, similarity, first_word, n_words.

    Words are compared without A-Z case and marks at their ends. Null and empty
    texts and texts or items of under five words match nothing. Repeated rows
    and repeated items each give rows of their own. The benchmark's items travel
    with the tasks, ``ITEMS_A_PASS`` at a time. A larger benchmark takes more passes
    over the documents, one after the other: each is written before the next one's
    items are indexed, so neither driver nor tasks hold more than two passes' items.
    """
    kept = [quoted(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(quoted(text_col).cast("string").alias("text"), *kept)
    kinds = {"item_id": T.StringType(), "similarity": T.DoubleType(), "first_word": T.LongType(), "n_words": T.LongType()}
    schema = T.StructType(rows.schema.fields[1:] + [T.StructField(n, k) for n, k in kinds.items()])
    out = None

    def one_pass(index: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                of, found = [], []
                for i, got in enumerate(index.value.leaks(t.as_py() for t in b.column(0))):
                    of += [i] * len(got)
                    found += got
                cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
                arrow = [pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of, pa.int64())) for c in b.columns[1:]), *(pa.array(c, k) for c, k in zip(cols, arrow, strict=True))], [*b.schema.names[1:], *kinds])
            give_back()

        return rows.mapInArrow(run, schema)

    for index, last in _indexes(benchmark, item_col, item_text):
        found = one_pass(index)
        if not last:
            found = materialise(found, "leaks")
            index.destroy()
        out = found if out is None else out.unionByName(found)
    return out.withColumn("item_id", F.col("item_id").cast(dict(benchmark.dtypes)[item_col]))


def _indexes(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast indexes of ``ITEMS_A_PASS`` items each, and whether one is the last; the next is built when the one before is done with.

    An empty benchmark gives one empty index.
    """
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(quoted(item_col).cast("string").alias("i"), quoted(item_text).cast("string").alias("t")).toLocalIterator()
    lot = [(r.i, r.t) for r in islice(rows, ITEMS_A_PASS)]
    while True:
        following = [(r.i, r.t) for r in islice(rows, ITEMS_A_PASS)]
        yield sc.broadcast(Index(lot)), not following
        if not following:
            return
        lot = following


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item, decided row by row: all columns stay and nothing is shuffled.

    Of several passes each reads what the one before has kept and written.
    """
    at = docs.columns.index(text_col)
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def one_pass(rows: DataFrame, index: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not got for got in index.value.leaks(t.as_py() for t in b.column(at))], pa.bool_()))
            give_back()

        return rows.mapInArrow(run, rows.schema)

    for index, last in _indexes(benchmark, item_col, item_text):
        before, rows = rows, one_pass(rows, index)
        if not last:
            rows = materialise(rows, "clean")
            index.destroy()
            release(before)
    return rows.toDF(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every whole text of ``documents``."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_leaks(docs, items.select("item_id", "text"), ["doc_id"])
    return found.select(F.col("k0").alias("doc_id"), "item_id", F.round("similarity", 6).alias("similarity"), "first_word", "n_words")
