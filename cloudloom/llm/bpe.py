"""Byte-level BPE by backtracking over longest matches, exact and linear in a piece's length.

A sequence of tokens is the one that the merges produce exactly if every two
neighbours are: merging their joined bytes gives the two back. So a piece is
encoded by taking the longest match at each place whose neighbour agrees, and
stepping back where none does. Which of the matches agrees with the token before
it is memoised, as are whole pieces. Tokens that their own bytes don't merge into
take part only as whole pieces, where ranks are looked up directly.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cloudloom.llm.columns import quoted
from cloudloom.llm.memory import give_back

#: Entries after which a worker's memo starts anew (of pairs) or gives up its older half (of pieces), so its memory is bounded.
PIECES_KEPT, PAIRS_KEPT = 120_000, 200_000
#: Longer pieces aren't memoised.
LONG_PIECE = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id of a rank file (base64 and a number on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder of one vocabulary and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.names = {i: str(i) for i in self.bytes_of}
        #: Tokens that their own bytes merge into, each with the two that its last merge joins (a byte: itself twice).
        self.splits: dict[int, tuple[int, int]] = {}
        #: Whether merges come in the order of their ranks in each token, so that they can be undone by rank.
        self.ordered = True
        for b, i in ranks.items():
            parts = self.merged(b, i)
            if len(parts) == 2:
                self.splits[i] = (parts[0], parts[1])
                self.ordered &= max(parts) < i
            elif len(b) == 1 or self.merged(b) == [i]:
                self.splits[i] = (i, i)
                self.ordered &= len(b) == 1
        self.own = {b: i for b, i in ranks.items() if i in self.splits}
        #: Every start of a token, with the longest token that it starts with itself.
        self.starts: dict[bytes, int] = {b"": -1}
        #: Each token's longest proper prefix that is a token: the next choice at the same place.
        self.shorter: dict[int, int] = {}
        for b, i in self.own.items():
            best = -1
            for k in range(1, len(b)):
                best = self.own.get(b[:k], best)
                self.starts[b[:k]] = best
            self.starts[b] = i
            self.shorter[i] = best
        #: What follows a token where another one is the longest match, see ``following``.
        self.choices: dict[tuple[int, int], int] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, raw: bytes, below: int = 1 << 62) -> list[int]:
        """The merges of ranks ``below`` a limit one by one, lowest rank and leftmost first: the definition, for short byte strings."""
        rank_of, none = self.ranks.get, 1 << 62
        parts = [raw[i : i + 1] for i in range(len(raw))]
        ranks = [rank_of(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while ranks and (low := min(ranks)) < below:
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def agree(self, one: int, other: int) -> bool:
        """Whether the joined bytes of two tokens merge into just these two.

        The latest merge of either is undone until two bytes are left; at no
        time may the parts on both sides of the middle have merged earlier.
        """
        if not self.ordered:
            return self.merged(self.bytes_of[one] + self.bytes_of[other]) == [one, other]
        ranks, bytes_of, splits = self.ranks, self.bytes_of, self.splits
        limit = 1 << 62
        while True:
            across = ranks.get(bytes_of[one] + bytes_of[other])
            if across is not None and across < limit:
                return False
            left, right = splits[one][1], splits[other][0]
            if right == other and left == one:
                return True
            if right == other or (left != one and one > other):
                limit, one = one, left
            else:
                limit, other = other + 1, right  # of equal merges the left one comes first

    def following(self, before: int, token: int) -> int:
        """The longest one of a token and its prefixes that agrees with the token before it, -1 without any; memoised."""
        best = token
        while best >= 0 and not self.agree(before, best):
            best = self.shorter[best]
        if len(self.choices) >= PAIRS_KEPT:
            self.choices.clear()
        self.choices[before, token] = best
        return best

    def encode_piece(self, raw: bytes) -> tuple[int, ...]:
        """The ids of one piece of bytes."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        taken: list[int] = []
        dead: set[int] = set()  # places that no encoding starts from; what precedes doesn't matter, as an encoding is unique
        sizes, shorter, known, start = self.sizes, self.shorter, self.choices.get, self.starts.get
        at, size, token = 0, len(raw), None
        while at < size:
            if token is None:  # the longest match here; most end within four bytes
                end = min(at + 4, size)
                token = start(raw[at:end])
                while token is None:
                    end -= 1
                    token = start(raw[at:end])
                while 4 <= end - at < size - at and (more := start(raw[at : end + 1])) is not None:
                    token, end = more, end + 1
            while token >= 0:
                if taken:
                    agreed = known((taken[-1], token))
                    token = self.following(taken[-1], token) if agreed is None else agreed
                    if token < 0:
                        break
                if not dead or at + sizes[token] not in dead:
                    break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at += sizes[token]
                token = None
            else:
                dead.add(at)
                last = taken.pop()
                at -= sizes[last]
                token = shorter[last]
        return tuple(taken)

    def remember(self, new: dict[str, tuple[int, ...]]) -> None:
        """Keep pieces for later texts; of the older half only what was met again stays."""
        for piece, got in new.items():
            if len(piece) <= LONG_PIECE:
                if len(self.pieces) >= PIECES_KEPT // 2:
                    self.older, self.pieces = self.pieces, {}
                self.pieces[piece] = got

    def encode(self, text: str) -> list[int]:
        """The ids of a text, each match of the pattern encoded separately."""
        pieces = self.split.findall(text)
        found = list(map(self.pieces.get, pieces))
        if None in found:
            new: dict[str, tuple[int, ...]] = {}
            for at, got in enumerate(found):
                if got is None:
                    piece = pieces[at]
                    got = new.get(piece) or self.older.get(piece) or self.encode_piece(piece.encode("utf-8", "replace"))
                    found[at] = new[piece] = got
            self.remember(new)
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str, ranks: dict[bytes, int]) -> Codec:
    """The worker's codec of a vocabulary, built once for all its tasks."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: list[str], text_col: str = "text", ids: bool = True) -> DataFrame:
    """``keep`` columns (as k0, k1, ...), n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids.

    ``path`` is a rank file on the driver; its table goes to the tasks as a
    broadcast (a vocabulary: its size doesn't follow the data). Null texts are
    like empty ones: no ids, digests of nothing. Every row has its own result.
    """
    table = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, table.value)
        for b in batches:
            count, sha, back, lists = [], [], [], []
            for t in b.column(0):
                got = own.encode(t.as_py() or "")
                count.append(len(got))
                sha.append(hashlib.sha256(",".join(map(own.names.__getitem__, got)).encode()).hexdigest())
                back.append(hashlib.sha256(own.decode(got)).hexdigest())
                if ids:
                    lists.append(got)
            more = [pa.array(lists, pa.list_(pa.int32()))] if ids else []
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()), *more], [*names, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * ids])
        give_back()

    rows = docs.select(quoted(text_col).cast("string").alias("text"), *[quoted(c).alias(n) for c, n in zip(keep, names, strict=True)])
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids
    schema = T.StructType(rows.schema.fields[1:] + T._parse_datatype_string(more).fields)
    return rows.mapInArrow(run, schema)


def decode_documents(rows: DataFrame, path: str, keep: list[str], ids_col: str = "token_ids") -> DataFrame:
    """``keep`` columns (as k0, k1, ...) and ``content``, the bytes of the ids; null ids give null."""
    table = rows.sparkSession.sparkContext.broadcast({i: b for b, i in read_ranks(path).items()})
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else b"".join(map(table.value.__getitem__, x)) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.binary())], [*names, "content"])

    picked = rows.select(quoted(ids_col).alias("ids"), *[quoted(c).alias(n) for c, n in zip(keep, names, strict=True)])
    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[1:], T.StructField("content", T.BinaryType())]))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of ``documents`` under the 50k multilingual ranks, and their bytes again."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"], ids=False)
    return out.withColumnRenamed("k0", "doc_id")
