"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions, each made at one of the 255 nodes of the
byte's prefix tree; contexts are the last 0 to ``DEPTH`` bytes. A context's
decision has a Krichevsky-Trofimov estimate from its counts, and every context's
weighted probability is half its own estimate and half the product of its longer
contexts' weighted probabilities. Predicting mixes the estimates of all depths
along a context's path by those weights.

Training counts the corpus's grams of ``DEPTH`` bytes and the byte after them
(summed in tasks, then by key), takes the counts at all depths from them, and
weighs the tree upwards with one aggregation a depth. Mixing goes down again, a
join of each depth with the one above: a decision's probability is a running sum,
and the weight that is left for longer contexts. So every gram of the corpus,
those of texts that are scored only included, gets its log probability in tables
as large as the corpus's distinct grams; nothing of that size is held anywhere.

Scoring is one pass over the texts: the ``FREQUENT_GRAMS`` most frequent grams are
broadcast, a text's other grams are counted per row and joined.

A plain unigram model of words with add-one smoothing stands beside it: the most
frequent ``FREQUENT`` words are broadcast, counts of all others are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm.columns import quoted
from cloudloom.llm.words import LOWER, lower_words
from cloudloom.workspace import materialise, release

DEPTH, FREQUENT, FREQUENT_GRAMS = 5, 1 << 16, 1 << 21
#: Bytes of texts laid out at a time, grams and words that a task sums before it sends them on, texts scored at a time.
LAYOUT, KEYS_HELD, WORDS_HELD, TEXTS = 1 << 20, 2_000_000, 250_000, 512
#: Stands before and after every text; no UTF-8 text holds it.
EDGE = b"\xff"
#: Node and bit of each of a byte's eight decisions: nodes are 1 to 255, heap-ordered.
_BYTES = np.arange(256)[:, None]
NODES = (1 << np.arange(8)) | (_BYTES >> (8 - np.arange(8)))
BITS = (_BYTES >> (7 - np.arange(8))) & 1
DECISIONS = "transform(sequence(0, 7), m -> named_struct('node', (1 << m) | (byte >> (8 - m)), 'bit', (byte >> (7 - m)) & 1))"


def layouts(texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, offset, keys of grams, keys to ignore) of texts laid end to end.

    A key is ``DEPTH`` bytes of context and one byte to predict. Long texts come in
    several pieces, null is like an empty text, of which the edge is predicted.
    """
    of, parts, size = [], [], 0

    def lay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        keys = flat[: len(flat) - DEPTH].copy()
        for j in range(1, DEPTH + 1):
            keys <<= 8
            keys |= flat[j : len(flat) - DEPTH + j]
        ends = np.cumsum([len(p) for p in parts])
        return np.array(of), np.concatenate(([0], ends[:-1])), keys, (ends[:-1, None] - DEPTH + np.arange(DEPTH)).ravel()

    for i, text in enumerate(texts):
        raw = EDGE * DEPTH + (text or "").encode("utf-8", "replace").translate(LOWER) + EDGE
        for at in range(0, len(raw) - DEPTH, LAYOUT):
            of.append(i)
            parts.append(raw[at : at + LAYOUT + DEPTH])
            size += len(parts[-1])
            if size >= LAYOUT:
                yield lay()
                of, parts, size = [], [], 0
    if parts:
        yield lay()


def held_out(doc_id: Column) -> Column:
    """Whether a document is scored only: CRC-32 of its id as text is 2 modulo 7; a null id never is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def count_grams(rows: DataFrame) -> DataFrame:
    """``(key, n, m)`` of rows ``(text, held_out)``: how often a gram occurs in training texts, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _, _ in held]), return_inverse=True)
            return keys, *(np.bincount(at, np.concatenate([x[i] for x in held])).astype(np.int64) for i in (1, 2))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["key", "n", "m"])

        for b in batches:
            texts, apart = b.column(0).to_pylist(), b.column(1).to_pylist()
            for scored_only in (False, True):
                for _, _, keys, skip in layouts(t for t, a in zip(texts, apart, strict=True) if a == scored_only):
                    found, m = np.unique(np.delete(keys, skip), return_counts=True)
                    held.append((found, m * (not scored_only), m))
                    if sum(len(k) for k, _, _ in held) > KEYS_HELD:
                        held = [summed()]
                        if len(held[0][0]) > KEYS_HELD // 2:
                            yield batch()
                            held = []
        if held:
            yield batch()

    return rows.mapInArrow(run, "key long, n long, m long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _lgamma(x: Column) -> Column:
    """log of the gamma function for x of 0.5 or more (Stirling's series at x + 8)."""
    z, low = x + 8, F.lit(0.0)
    for k in range(8):
        low = low + F.log(x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - low


def _shorter(depth: int) -> Column:
    """The last ``depth`` bytes of a context."""
    return F.col("ctx").bitwiseAND((1 << 8 * depth) - 1)


def _decided(grams: DataFrame, *more: str) -> DataFrame:
    """A row for each of a gram's eight decisions."""
    cut = grams.select(F.shiftright("key", 8).alias("ctx"), F.col("key").bitwiseAND(255).cast("int").alias("byte"), *more)
    return cut.select("ctx", *more, F.explode(F.expr(DECISIONS)).alias("d")).select("ctx", *more, "d.node", "d.bit")


def weigh(grams: DataFrame) -> list[DataFrame]:
    """For depths 0 to DEPTH ``(ctx, node, kt, own)``: the estimate of a 1, and its weight against longer contexts."""
    count = lambda bit: F.sum(F.when(F.col("bit") == bit, F.col("n")).otherwise(0)).alias(f"n{bit}")
    level = _decided(grams.where("n > 0"), "n").groupBy("ctx", "node").agg(count(0), count(1))
    out: list[DataFrame] = []
    for depth in range(DEPTH, -1, -1):
        if depth < DEPTH:
            level = out[0].groupBy(_shorter(depth).alias("ctx"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("longer"))
        n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
        level = level.withColumn("estimate", _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1) - math.log(math.pi))
        apart = F.lit(None) if depth == DEPTH else F.col("estimate") - F.col("longer")
        both = F.col("estimate") if depth == DEPTH else F.greatest("estimate", "longer") + F.log1p(F.exp(-F.abs(apart))) - math.log(2)
        level = level.withColumn("weighted", both).withColumn("own", F.lit(1.0) if depth == DEPTH else 1 / (1 + F.exp(-apart)))
        out.insert(0, materialise(level.select("ctx", "node", "n0", "n1", "weighted", ((n1 + 0.5) / (n0 + n1 + 1)).alias("kt"), "own"), f"depth{depth}"))
    return out


def mix(levels: list[DataFrame]) -> list[DataFrame]:
    """For depths 0 to DEPTH ``(ctx, node, p, rest)``: the share of a 1 that these and shorter contexts give, and the weight left for longer ones."""
    out = [materialise(levels[0].select("ctx", "node", (F.col("own") * F.col("kt")).alias("p"), (1 - F.col("own")).alias("rest")), "mixed0")]
    for depth in range(1, DEPTH + 1):
        above = out[-1].select(F.col("ctx").alias("up"), F.col("node").alias("at"), F.col("p").alias("p0"), F.col("rest").alias("r0"))
        above = F.broadcast(above) if depth <= 2 else above  # at most 255 * 256 rows
        joined = levels[depth].join(above, (_shorter(depth - 1) == F.col("up")) & (F.col("node") == F.col("at")))
        out.append(materialise(joined.select("ctx", "node", (F.col("p0") + F.col("r0") * F.col("own") * F.col("kt")).alias("p"), (F.col("r0") * (1 - F.col("own"))).alias("rest")), f"mixed{depth}"))
    return out


def _seen_logs(grams: DataFrame, deepest: DataFrame) -> DataFrame:
    """``(key, m, logp)`` of grams seen in training: all their decisions were seen in their whole context."""
    nodes = deepest.groupBy("ctx").agg(F.collect_list(F.struct("node", "p")).alias("at"))  # at most 255
    byte = F.col("key").bitwiseAND(255).cast("int").alias("byte")
    keys = grams.groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.collect_list(F.struct(byte, "m")).alias("of"))  # at most 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 2048) for x in batches for i in range(0, x.num_rows, 2048)):
            ctx, (row, node, p), (own, byte, m) = np.asarray(b.column(0)), _flat(b.column(1)), _flat(b.column(2))
            one = np.full((len(ctx), 256), 0.5)
            one[row, node] = p
            ones = one[own[:, None], NODES[byte]]
            logs = np.log10(np.where(BITS[byte] == 1, ones, 1 - ones)).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ctx[own] << 8 | byte), pa.array(m), pa.array(logs)], ["key", "m", "logp"])

    return nodes.join(keys, "ctx").mapInArrow(run, "key long, m long, logp double")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(row, first field, second field) of every struct in an array of lists."""
    each = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    return row, *(np.asarray(each.field(i)) for i in (0, 1))


def _unseen_logs(grams: DataFrame, mixed: list[DataFrame]) -> DataFrame:
    """``(key, m, logp)`` of other grams: each decision by the longest context that it was seen in; never seen, it is a half."""
    rows = _decided(grams.withColumn("gram", F.col("key")), "gram", "m").withColumn("one", F.lit(None).cast("double"))
    for depth in range(DEPTH, -1, -1):
        # what longer contexts haven't seen they take for a half
        level = mixed[depth].select(F.col("ctx").alias("up"), F.col("node").alias("at"), (F.col("p") + F.col("rest") / 2).alias("found"))
        level = F.broadcast(level) if depth <= 1 else level  # at most 255 * 256 rows
        joined = rows.join(level, (_shorter(depth) == F.col("up")) & (F.col("node") == F.col("at")), "left")
        rows = joined.select("ctx", "gram", "m", "node", "bit", F.coalesce("one", "found").alias("one"))
    one = F.coalesce("one", F.lit(0.5))
    logs = F.sum(F.log10(F.when(F.col("bit") == 1, one).otherwise(1 - one)))
    return rows.groupBy(F.col("gram").alias("key"), "m").agg(logs.alias("logp"))


def gram_logs(grams: DataFrame) -> DataFrame:
    """``(key, m, logp)``: log10 probability of every gram's last byte after its context, from grams ``(key, n, m)``."""
    levels = weigh(grams)
    mixed = mix(levels)
    release(*levels)
    logs = _seen_logs(grams.where("n > 0"), mixed[DEPTH]).unionByName(_unseen_logs(grams.where("n = 0"), mixed))
    logs = materialise(logs, "logs")
    release(*mixed)
    return logs


class Grams:
    """The log probabilities of the most frequent grams, by a sorted table."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], logs[order]

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, whether known) of each key; 0 for those that aren't."""
        each, back = np.unique(keys, return_inverse=True)
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, each), len(self.keys) - 1)
        known = self.keys[at] == each
        return np.where(known, self.logs[at], 0.0)[back], known[back]


def frequent_grams(logs: DataFrame) -> Broadcast:
    """The grams of the highest occurrence classes (sixteen to a doubling) that hold FREQUENT_GRAMS together at most."""
    step = F.floor(F.log2("m") * 16).cast("int")
    sizes = {r.step: r.n for r in logs.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}  # at most 16 * 64
    total, least = 0, 1 << 30
    for s in sorted(sizes, reverse=True):
        if (total := total + sizes[s]) > FREQUENT_GRAMS:
            break
        least = s
    table = logs.where(step >= least).select("key", "logp").toArrow()
    return logs.sparkSession.sparkContext.broadcast(Grams(table.column("key").to_numpy(), table.column("logp").to_numpy()))


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, c)`` of a column of texts; the end of a text counts as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                held.update(lower_words(t.as_py()))
                held[b""] += 1
                if len(held) > WORDS_HELD:
                    yield words_of(held)
                    held = Counter()
        yield words_of(held)

    def words_of(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes)`` for every row of ``docs``.

    Both models learn from the rows that aren't held out. Null and empty texts
    have one token, the end; a null id is trained on. Repeated rows are trained
    on and scored each. Without any training text all bytes are equally likely.
    Other columns are ignored, an empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(text_col).cast("string").alias("text"), quoted(id_col).alias("doc_id"), held_out(quoted(id_col)).alias("held_out"))
    grams = materialise(count_grams(rows.select("text", "held_out")), "grams")
    logs = gram_logs(grams)
    release(grams)
    counts = materialise(count_words(rows.where("not held_out").select("text")), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    most = counts.orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    words = spark.sparkContext.broadcast(dict(zip(most.column("word").to_pylist(), most.column("c").to_pylist(), strict=True)))
    # rows are numbered in this pass and written with their numbers, so both joins below mean the same rows
    scored = materialise(_score_pass(rows, frequent_grams(logs), words), "scored")
    each = lambda name, n: scored.select("row", F.explode(F.arrays_zip(name, n)).alias("x")).select("row", F.col(f"x.{name}").alias("of"), F.col(f"x.{n}").alias("k"))
    known = each("words", "word_ns").join(counts, F.col("of") == F.col("word")).select("row", "k", (F.col("k") * F.log10(F.col("c") + 1)).alias("base"), F.lit(0.0).alias("logs"))
    rare = each("grams", "gram_ns").join(logs, F.col("of") == F.col("key")).select("row", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("base"), (F.col("k") * F.col("logp")).alias("logs"))
    more = known.unionByName(rare).groupBy("row").agg(F.sum("k").alias("more_known"), F.sum("base").alias("more_base"), F.sum("logs").alias("more_logs"))
    out = scored.drop("words", "word_ns", "grams", "gram_ns").join(more, "row", "left")
    plus = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    base = plus("base", "more_base", 0.0) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "more_known", 0).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), plus("score", "more_logs", 0.0).alias("score"), "n_bytes")


def _score_pass(rows: DataFrame, frequent: Broadcast, words: Broadcast) -> DataFrame:
    """Every row with a number, its scores by frequent grams and words, and its other grams and words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in (x.slice(i, TEXTS) for x in batches for i in range(0, x.num_rows, TEXTS)):
            texts = b.column(0).to_pylist()
            score, rare = np.zeros(len(texts)), []
            for of, at, keys, skip in layouts(iter(texts)):
                logs, known = frequent.value.look_up(keys)
                logs[skip] = 0
                known[skip] = True
                np.add.at(score, of, np.add.reduceat(logs, at))
                left = np.flatnonzero(~known)
                rare.append(np.stack((of[np.searchsorted(at, left, "right") - 1], keys[left])))
            pairs, n = np.unique(np.concatenate(rare, axis=1), axis=1, return_counts=True) if rare else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
            ends = pa.array(np.searchsorted(pairs[0], np.arange(len(texts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pairs[1], n)]
            cols = [pa.array(row + np.arange(len(texts))), pa.array(score), b.column(1), b.column(2), *_word_columns(texts, words.value), *lists]
            row += len(texts)
            yield pa.RecordBatch.from_arrays(cols, ["row", "score", "doc_id", "held_out", "n_tokens", "n_known", "base", "n_bytes", "words", "word_ns", "grams", "gram_ns"])

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"row long, score double, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, n_bytes long, words array<binary>, word_ns array<long>, grams array<long>, gram_ns array<long>"
    return rows.mapInArrow(run, schema)


def _word_columns(texts: list[str | None], frequent: dict[bytes, int]) -> list[pa.Array]:
    """n_tokens, n_known and summed log10(c + 1) by frequent words, n_bytes, and the other words with their numbers."""
    tokens, known, logs, size, words, ns = [], [], [], [], [], []
    log10, get = math.log10, frequent.get
    for t in texts:
        count = Counter(lower_words(t))
        count[b""] = 1
        tokens.append(count.total())
        hit, total, rare = 0, 0.0, []
        for w, k in count.items():
            c = get(w)
            if c is None:
                rare.append((w, k))
            else:
                hit += k
                total += k * log10(c + 1)
        known.append(hit)
        logs.append(total)
        size.append(len((t or "").encode("utf-8", "replace")))
        words.append([w for w, _ in rare])
        ns.append([k for _, k in rare])
    return [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(size, pa.int64()), pa.array(words, pa.list_(pa.binary())), pa.array(ns, pa.list_(pa.int64()))]


def op9_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of ``documents``."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
