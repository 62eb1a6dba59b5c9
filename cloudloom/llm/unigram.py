"""Token counts of a unigram vocabulary without building tokens.

An Aho-Corasick automaton lists all pieces that end at each place; Viterbi keeps
the best score and the number of pieces of every prefix, nothing else. Ties go
as in the public tokenizer: of equal scores the longest last piece wins, and a
character that is no piece itself competes as unknown, 10 below the lowest
score, last. Unknown characters count as their UTF-8 bytes.

Blanks become the mark U+2581, one stands before the text. No piece has a mark
behind another character, and none has a line feed, so texts are cut before
marks and at line feeds, and the counts of these short cuts are memoised.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm.columns import quoted

MARK = "▁"
UNKNOWN_BELOW = 10.0
#: Cuts after which a worker's memo starts anew, and the length from which cuts aren't kept.
CUTS_KEPT, LONG_CUT = 400_000, 64


def read_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model with their scores (no control, unknown or byte pieces)."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Counter:
    """Counts pieces of texts."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_BELOW
        self.matches = ahocorasick.Automaton()
        for p, s in pieces:
            self.matches.add_word(p, (len(p), s))
        if pieces:
            self.matches.make_automaton()
        self.any = bool(pieces)
        apart = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p, _ in pieces)
        self.cut = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if apart else "(?s).+")
        self.known: dict[str, tuple[int, float]] = {}

    def best(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation."""
        n, low = len(text), float("-inf")
        score, count = [0.0] + [low] * n, [0] * (n + 1)
        single = bytearray(n)

        def finish(end: int) -> None:
            """The unknown character before ``end``, after all its pieces."""
            if not single[end - 1] and (s := score[end - 1] + self.unknown) > score[end]:
                score[end], count[end] = s, count[end - 1] + len(text[end - 1].encode("utf-8", "replace"))

        done = 0
        for last, (size, value) in self.matches.iter(text) if self.any else ():
            end = last + 1
            while done < last:
                done += 1
                finish(done)
            if size == 1:
                single[last] = 1
            if (s := score[end - size] + value) > score[end]:  # longest first: an equal shorter piece doesn't win
                score[end], count[end] = s, count[end - size] + 1
        while done < n:
            done += 1
            finish(done)
        return count[n], score[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """(pieces, score) of a text; null and empty texts have none."""
        if not text:
            return 0, 0.0
        total, score, known = 0, 0.0, self.known
        for cut in self.cut.findall(MARK + text.replace(" ", MARK)):
            got = known.get(cut)
            if got is None:
                got = self.best(cut)
                if len(cut) <= LONG_CUT:
                    if len(known) >= CUTS_KEPT:
                        known.clear()
                    known[cut] = got
            total += got[0]
            score += got[1]
        return total, score


_counters: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns (as k0, k1, ...), n_tokens and score for every row.

    ``pieces`` are broadcast (a vocabulary's size doesn't follow the data). Null
    and empty texts have no tokens, every row its own count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(shared.value))
        own = _counters.get(key) or _counters.setdefault(key, Counter(shared.value))
        for b in batches:
            got = [own.count(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], [*names, "n_tokens", "score"])

    rows = docs.select(quoted(text_col).cast("string").alias("text"), *[quoted(c).alias(n) for c, n in zip(keep, names, strict=True)])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())]))


def op6_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole text of ``documents`` under the 32k vocabulary and its own scores."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, read_pieces(public_tokenizers.path("piece_bpe_32k.model")), ["doc_id"]).withColumnRenamed("k0", "doc_id")
