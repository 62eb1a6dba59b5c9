"""Quality by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Rules look at one document's statistics and vote good (1), bad (0) or abstain
(-1). How often each combination of votes occurs in the corpus is all that
fitting needs: a table of vote patterns whose size depends on the number of
rules only (3^rules), counted with map-side combining. Expectation-maximisation
on it gives every rule's votes given good and given bad texts and the share of
good texts; a document's posterior then follows from its own pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm.columns import quoted
from cloudloom.llm.memory import give_back
from cloudloom.llm.words import WORD
from cloudloom.workspace import materialise

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_lone", "n_marked_words", "n_distinct", "n_ended")
SYMBOLS = "#*$%&|<>"
CAPITALS = re.compile(rb"[A-Z]")
LONE = re.compile(rb"(?<![^ ])[^A-Za-z0-9\x80-\xff ]+(?![^ ])")  # a word of ASCII marks only
MARKED = re.compile(rb"[#*$%&!<>]{2}(?![^ ])")  # a word's end of two marks or more
WIDE = bytes(range(128, 256))
PLAIN = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENDED = re.compile(rb"[.?!](?![^ ])")
WINDOW = 5
#: Base filter: too short, or over a fifth of the words in repeated windows.
LEAST_WORDS, REPEAT_PERCENT = 10, 20
#: Rounds of EM, the prior counts of each vote, and the posterior from which a text stays.
ROUNDS, SMOOTH, KEEP_FROM = 100, 1.0, 0.5

#: Rules: name, SQL for a vote of bad, SQL for a vote of good; neither: abstain.
RULES = (
    ("symbols", "20 * n_symbols > word_chars", "200 * n_symbols <= word_chars"),
    ("marked_words", "10 * n_marked_words > 3 * n_words", "false"),
    ("capitals", "2 * n_upper > n_letters", "false"),
    ("lone_marks", "10 * n_lone > n_words", "false"),
    ("letters", "10 * n_letters < 9 * word_chars", "100 * n_letters >= 93 * word_chars"),
    ("repeated_words", "10 * n_repeat_words > n_words", "false"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines", "false"),
    ("word_length", "word_chars > 14 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    ("variety", "n_words >= 50 and 10 * n_distinct < 2 * n_words", "false"),
    ("sentences", "n_words >= 50 and 50 * n_ended < n_words", "50 * n_ended >= n_words"),
)


def text_stats(text: str | None) -> tuple[int, ...]:
    """The STATS of a text; null is like an empty text, which has zeros (and no line)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = WORD.findall(raw)
    n = len(words)
    joined = b" ".join(words)
    repeat = 0
    if n >= WINDOW:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - WINDOW] + 1))
        digest = xxhash.xxh3_64_intdigest
        keys = np.fromiter((digest(joined[a:b]) for a, b in zip(starts.tolist(), ends[WINDOW - 1 :].tolist(), strict=True)), np.uint64, len(starts))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        if same.any():
            twice = np.zeros(n + 1, np.int64)
            hit = np.concatenate((order[:-1][same], order[1:][same]))
            hit = np.unique(hit)
            np.add.at(twice, hit, 1)
            np.add.at(twice, hit + WINDOW, -1)
            repeat = int((np.cumsum(twice)[:n] > 0).sum())
    lines = [x for x in raw.split(b"\n") if WORD.search(x)]
    plain = joined.decode("utf-8", "surrogatepass")
    wide = len(plain) - len(joined.translate(None, WIDE))
    upper = len(CAPITALS.findall(joined))
    if wide and len(low := plain.lower()) == len(plain):
        upper = int((_points(low) != _points(plain)).sum())
    dup_lines = len(lines) - len(set(lines))
    symbols = sum(map(text.count, SYMBOLS))
    return (n, len(plain) - max(0, n - 1), symbols, dup_lines, repeat, len(lines), wide + len(joined) - len(joined.translate(None, PLAIN)), upper, len(LONE.findall(joined)), len(MARKED.findall(joined)), len(set(words)), len(ENDED.findall(joined)))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def with_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns (named k0, k1, ...) and the STATS of every whole text, one pass."""
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([text_stats(t.as_py()) for t in b.column(0)], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(rows[:, i]) for i in range(len(STATS)))], [*names, *STATS])
        give_back()

    rows = docs.select(quoted(text_col).cast("string").alias("text"), *[quoted(c).alias(n) for c, n in zip(keep, names, strict=True)])
    schema = T.StructType(rows.schema.fields[1:] + [T.StructField(s, T.LongType()) for s in STATS])
    return rows.mapInArrow(run, schema)


def with_votes(stats: DataFrame, rules=RULES) -> DataFrame:
    """``votes``: one character a rule, 1 good, 0 bad, - abstaining; texts without words abstain throughout."""
    vote = lambda bad, good: F.expr(f"case when n_words = 0 then '-' when {bad} then '0' when {good} then '1' else '-' end")
    return stats.withColumn("votes", F.concat(*[vote(b, g) for _, b, g in rules]))


def fit(patterns: dict[str, int], rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """The share of good texts and log P(vote | class) as (rules, classes bad/good, votes 0/1/-).

    Starts from the majority vote, in which good and bad votes count alike.
    Without any pattern the share is one half and all votes are equally likely.
    """
    if not patterns:
        return 0.5, np.zeros((0, 2, 3))
    keys, n = list(patterns), np.array(list(patterns.values()), float)
    votes = np.array([["01-".index(c) for c in k] for k in keys])
    one = np.eye(3)[votes]  # patterns, rules, votes
    good = ((votes == 1).sum(1) + 0.5) / ((votes == 1).sum(1) + (votes == 0).sum(1) * 2 + 1.0)
    for _ in range(rounds):
        share = ((good * n).sum() + 1) / (n.sum() + 2)
        weight = np.stack((n * (1 - good), n * good), 1)
        count = np.einsum("pc,prv->rcv", weight, one) + SMOOTH
        logs = np.log(count / count.sum(2, keepdims=True))
        score = np.einsum("rcv,prv->pc", logs, one) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -700, 700)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return float(share), logs


def posterior(patterns: dict[str, int], rules=RULES) -> dict[str, float]:
    """P(good | votes) of every pattern. Good is the class with fewer bad votes."""
    share, logs = fit(patterns)
    out = {}
    flip = bool(len(logs)) and np.exp(logs[:, 1, 0]).sum() > np.exp(logs[:, 0, 0]).sum()
    for k in patterns:
        s = np.log([1 - share, share]) + sum((logs[i, :, "01-".index(c)] for i, c in enumerate(k)), np.zeros(2))
        p = float(1 / (1 + np.exp(np.clip(s[0] - s[1], -700, 700))))
        out[k] = 1 - p if flip else p
    return out


def score_quality(docs: DataFrame, keep: list[str], text_col: str = "text", rules=RULES) -> DataFrame:
    """``keep`` columns (as k0, k1, ...), the STATS, votes, posterior, base_failed and kept for every row.

    Null and empty texts have no words: they fail the base filter. Repeated rows
    are judged alike, row by row. Statistics are written once; fitting reads the
    vote patterns (at most 3^rules of them), never the rows.
    """
    spark = docs.sparkSession
    rows = materialise(with_votes(with_stats(docs, keep, text_col), rules), "votes")
    counts = {r.votes: r.n for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    table = spark.createDataFrame(sorted(posterior(counts, rules).items()) or [("", 0.0)], "votes string, posterior double")
    failed = F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")
    judged = rows.join(F.broadcast(table), "votes", "left").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, votes and verdict of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score_quality(docs.select("doc_id", "text"), ["doc_id"])
    return out.select(F.col("k0").alias("doc_id"), *STATS[:5], "base_failed", "kept", F.round("posterior", 6).alias("posterior"), "votes")
