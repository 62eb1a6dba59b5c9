"""Token ids as files of Simple-8b words.

A 64-bit word has a selector in its top four bits and ids of one width below it,
the first one lowest. Ids are coded in blocks of ``BLOCK``, each from a new word,
and every record keeps the blocks' word offsets, so any block is decoded alone
and all blocks at once with a few vector operations. An id of 2^60 or more is an
escape: its word has selector 0, its value stands in the record's list of escaped
values, in order. Selector 1 is not used.

A file is Parquet with one record for a run of whole documents: ``part`` (the
file's place in document order), ``first`` (ids in the file before the record),
``doc_ids``, ``n_ids`` (ids of each document), ``offsets`` and ``words`` and
``escaped`` as little-endian 64-bit integers. Files are written by Spark's own
committer, so a lost task leaves nothing behind, and can lie in any store.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudloom.llm.columns import quoted
from cloudloom.workspace import new_path

#: Fixed by the format: ids and bits for the selectors 2 to 15; 0 is the escape.
COUNT = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
BLOCK, PAD = 1024, 60
#: Bit lengths of ids below 2^17.
LENGTHS = np.frexp(np.arange(1 << 17, dtype=np.float64))[1].astype(np.uint8)
#: Ids after which a record ends, bytes of texts encoded at a time, and words and pieces that a worker remembers.
RECORD_IDS, TEXT_BYTES, WORDS_KEPT = 1 << 16, 8 << 20, 1_200_000
RECORD = "part int, first long, doc_ids array<long>, n_ids array<long>, offsets array<int>, words binary, escaped binary"


def _blocks(ids: np.ndarray) -> np.ndarray:
    """Ids as rows of BLOCK, with zeros behind them and PAD more in each row."""
    rows = np.zeros((-(-len(ids) // BLOCK), BLOCK + PAD), np.uint64)
    full = np.zeros(len(rows) * BLOCK, np.uint64)
    full[: len(ids)] = ids
    rows[:, :BLOCK] = full.reshape(-1, BLOCK)
    return rows


def _selectors(rows: np.ndarray) -> np.ndarray:
    """The selector that packs most ids from each place on."""
    if int(rows.max()) < len(LENGTHS):
        bits = LENGTHS[rows.astype(np.int64)]
    else:
        bits = np.zeros(rows.shape, np.uint8)
        for k in (32, 16, 8, 4, 2, 1):
            more = rows >> (bits + np.uint8(k)).astype(np.uint64) > 0
            bits += more.astype(np.uint8) * np.uint8(k)
        bits += rows > 0
    # bits[i] is now the length of id i

    def longest(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
        out = a.copy()
        out[:, : out.shape[1] - by] = np.maximum(a[:, : a.shape[1] - by], b[:, by:])
        return out

    over = {1: bits}
    for c, (a, b) in {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2), 7: (4, 3), 8: (4, 4), 10: (8, 2), 12: (8, 4), 15: (8, 7), 20: (15, 5), 30: (15, 15), 60: (30, 30)}.items():
        over[c] = longest(over[a], over[b], a)
    best = np.where(bits <= 60, np.uint8(15), np.uint8(0))
    for s in range(14, 1, -1):
        best[over[int(COUNT[s])] <= WIDTH[s]] = s
    return best[:, :BLOCK]


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of every block, escaped values) of ids; no ids give no words."""
    ids = np.asarray(ids, np.uint64)
    if not len(ids):
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.uint64)
    rows = _blocks(ids)
    best = _selectors(rows)
    steps = COUNT[best].tolist()
    starts, offsets = [], []
    for block, step in enumerate(steps):
        offsets.append(len(starts))
        at, end, base = 0, min(BLOCK, len(ids) - block * BLOCK), block * (BLOCK + PAD)
        while at < end:
            starts.append(base + at)
            at += step[at]
    place = np.array(starts)
    chosen = best[place // (BLOCK + PAD), place % (BLOCK + PAD)]
    flat, words = rows.ravel(), chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen[chosen > 0]):
        of = np.flatnonzero(chosen == s)
        shifts = (np.arange(COUNT[s]) * WIDTH[s]).astype(np.uint64)
        words[of] |= np.bitwise_or.reduce(flat[place[of, None] + np.arange(COUNT[s])] << shifts, axis=1)
    return words, np.array(offsets, np.int32), flat[place[chosen == 0]]


def decode(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a record."""
    if not n:
        return np.empty(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[chosen]
    block = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    before = np.concatenate(([0], np.cumsum(count)))
    place = before[:-1] - before[offsets[block]] + block * (BLOCK + PAD)
    rows = np.zeros((len(offsets), BLOCK + PAD), np.uint64)
    flat = rows.reshape(-1)
    for s in np.unique(chosen):
        of = np.flatnonzero(chosen == s)
        if s == 0:
            flat[place[of]] = escaped
            continue
        shifts, mask = (np.arange(COUNT[s]) * WIDTH[s]).astype(np.uint64), np.uint64((1 << int(WIDTH[s])) - 1)
        flat[place[of, None] + np.arange(COUNT[s])] = (words[of, None] >> shifts) & mask
    return rows[:, :BLOCK].reshape(-1)[:n]


def _cutter(spec: dict) -> regex.Pattern | None:
    """The pattern that cuts a tokenizer's words into pieces, where pieces are what its model is asked for one by one.

    That is so if texts are only composed, blanks folded and lower-cased, pieces are cut by one pattern and their
    bytes mapped, no token that is found in raw texts lacks a ``<``, and merges aren't random.
    """
    normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = sorted(normal) == ["Lowercase", "NFC", "Replace"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
    if not plain or spec["model"].get("type") != "BPE" or spec["model"].get("dropout") or spec.get("post_processor"):
        return None
    split, mapped = steps
    usual = split.get("invert") and split.get("behavior") == "Removed" and not mapped.get("add_prefix_space") and not mapped.get("use_regex")
    marked = all("<" in t["content"] for t in spec.get("added_tokens", []))
    return regex.compile(split["pattern"]["Regex"]) if usual and marked and "Regex" in split["pattern"] else None


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


#: Words whose letters are composed, have one lower case each and are no blanks, so that they can be cut without the tokenizer.
_EASY = r"^[\x{21}-\x{3b}\x{3d}-\x{7e}\x{a1}-\x{12f}\x{131}-\x{24f}]+$"
_LETTERS = dict(enumerate(_byte_letters()))


class WordTokenizer:
    """A ``tokenizers`` tokenizer that never looks across ASCII white space, with its words remembered.

    Words are told apart by Arrow, a batch at a time; a word's ids lie in one pool
    of ids, the dictionary holds its place only. New words are cut into pieces,
    and the tokenizer's model is asked for the pieces that are new; words that
    could be cut in another way go through the whole tokenizer.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.cutter = _cutter(json.loads(spec))
        self.pieces = self.cutter and regex.compile(f"{self.cutter.pattern}| ")
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.pool, self.ends = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)  # both grow by doubling

    def _add(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        """Remember words by their ids, which lie end to end."""
        n, used = len(self.place), int(self.ends[len(self.place)])
        self.place.update(zip(words, range(n, n + len(words)), strict=True))
        if len(self.place) >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros(max(len(self.ends), len(words)), np.int64)))
        if used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty(max(len(self.pool), len(flat)), np.uint32)))
        self.pool[used : used + len(flat)] = flat
        self.ends[n + 1 : n + 1 + len(words)] = used + np.cumsum(sizes)

    def _add_lists(self, words: list[str], ids: list[list[int]]) -> None:
        self._add(words, np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of remembered words end to end, and the number of each one's."""
        first = self.ends[at]
        sizes = self.ends[at + 1] - first
        stops = np.cumsum(sizes)
        return self.pool[np.arange(stops[-1] if len(stops) else 0) + np.repeat(first - stops + sizes, sizes)], sizes

    def _learn(self, words: list[str]) -> None:
        is_easy = [False] * len(words) if self.cutter is None else pc.match_substring_regex(pa.array(words, pa.string()), _EASY).to_pylist()
        easy, hard = list(compress(words, is_easy)), [w for w, e in zip(words, is_easy, strict=True) if not e]
        for i in range(0, len(hard), 200):
            self._add_lists(hard[i : i + 200], self._whole(hard[i : i + 200]))
        if not easy:
            return
        found = pa.array(self.pieces.findall(" ".join(easy).lower()), pa.string()).dictionary_encode()
        pieces, of = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        tokenize = self.model.tokenize
        fresh = [p for p in pieces if p not in self.place and p != " "]
        self._add_lists(fresh, [[t.id for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_LETTERS))] for p in fresh])
        blank = pieces.index(" ") if " " in pieces else -1
        at = np.array([self.place.get(p, -1) for p in pieces], np.int64)[of[of != blank]]
        flat, sizes = self._gather(at)
        word = np.cumsum(of == blank)[of != blank]
        total = np.bincount(word, sizes, len(easy)).astype(np.int64)
        other = np.array([w not in self.place for w in easy], bool)  # the rest are pieces themselves
        self._add(list(compress(easy, other.tolist())), flat[np.repeat(other, total)], total[other])

    def _whole(self, words: list[str]) -> list[list[int]]:
        """Each word's ids from the whole tokenizer, many words in a text, told apart by their tokens' offsets."""
        coded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        of = np.searchsorted(starts, np.array([a for a, _ in coded.offsets], np.int64), "right") - 1
        out: list[list[int]] = [[] for _ in words]
        for w, i in zip(of.tolist(), coded.ids, strict=True):
            out[w].append(i)
        return out

    def encode(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts without special tokens, ``end`` after each, and the number of each text's."""
        if self.cutter is not None:  # a word's case matters only where it may be a token found in raw texts
            texts = pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)  # blanks at either end give empty words, which have no ids
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.place) > WORDS_KEPT:
            self._forget()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(at < 0).tolist()):
            self._learn([words[i] for i in new])
            at[new] = [self.place[words[i]] for i in new]
        of = coded.indices.to_numpy()
        flat, sizes = self._gather(at[of])
        stops = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(pc.list_value_length(split).to_numpy())]
        ids = np.insert(flat, np.repeat(stops, len(end)), np.tile(np.array(end, np.uint32), len(texts)))
        return ids, np.diff(stops, prepend=0) + len(end)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts of about TEXT_BYTES together, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right")))
        yield at, stop - at
        at = stop


_tokenizers: dict[int, WordTokenizer] = {}


def write_token_files(docs: DataFrame, spec: str, path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts to files in ascending order of ``id_col``, each document followed by ``end_id``.

    ``spec`` is a tokenizer's JSON; it is broadcast (a vocabulary's size doesn't
    follow the data). Null and empty texts have no ids but the end; null keys
    come first; rows with equal keys are ordered by their texts' hashes. An
    empty table gives files without records.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    end = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        own = _tokenizers.get(key) or _tokenizers.setdefault(key, WordTokenizer(shared.value))
        part, first = TaskContext.get().partitionId(), 0
        keys, ids, counts = pa.array([], pa.int64()), np.empty(0, np.uint32), np.empty(0, np.int64)

        def record(docs: int) -> pa.RecordBatch:
            words, offsets, escaped = encode(ids[: int(counts[:docs].sum())])
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (keys[:docs], pa.array(counts[:docs]), pa.array(offsets))]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), *lists, pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([escaped.astype("<u8").tobytes()], pa.binary())], ["part", "first", "doc_ids", "n_ids", "offsets", "words", "escaped"])

        for b in batches:
            for at, n in _slices(b.column(1)):
                got, sizes = own.encode(b.column(1).slice(at, n), end)
                keys, ids, counts = pa.concat_arrays([keys, b.column(0).slice(at, n)]), np.concatenate((ids, got)), np.concatenate((counts, sizes))
                while len(ids) >= RECORD_IDS:
                    docs = int(np.searchsorted(np.cumsum(counts), RECORD_IDS)) + 1
                    yield record(docs)
                    done = int(counts[:docs].sum())
                    first += done
                    keys, ids, counts = keys[docs:], ids[done:], counts[docs:]
        if len(keys):
            yield record(len(keys))

    ordered.mapInArrow(run, RECORD).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` of every document in the files.

    ``start`` counts all ids before the document; the checksum is that of its ids
    as little-endian 32-bit integers (null if one is larger); ``ids`` can be left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = np.array(r["n_ids"], np.int64)
                words, escaped = (np.frombuffer(r[k], "<u8").astype(np.uint64) for k in ("words", "escaped"))
                ids = decode(words, np.array(r["offsets"], np.int64), escaped, int(n.sum()))
                ends = np.concatenate(([0], np.cumsum(n)))
                fit = memoryview(ids.astype("<u4").tobytes()) if not len(ids) or int(ids.max()) < 1 << 32 else None
                crc = [None if fit is None else zlib.crc32(fit[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["before"] + r["first"] + ends[:-1]), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return _placed(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The records with ``before``, the ids of all files before their own; one row a file meets in the window."""
    records = spark.read.schema(RECORD).parquet(path)
    sizes = records.groupBy("part").agg(F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    sizes = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return records.join(F.broadcast(sizes), "part")  # as many rows as files


def op2_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode ``documents`` into files, then take every document's place and checksum from the files."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    path = new_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), spec, path)

    return read_token_files(spark, path, with_ids=False)
