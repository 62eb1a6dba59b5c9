"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within a radius share a variant that lies within half the
radius of each, so near pairs meet in a shuffle on variants and nowhere else.

``near_fingerprints`` is exact for radius 3. Every fingerprint takes part with
itself and its 64 one-bit flips. Three differing bits need a two-bit flip on one
side: the two ends then differ in parity, so only fingerprints of even parity
take two-bit flips, and of three bits two always lie in the same 32-bit half, so
992 of the 2016 two-bit flips are enough.

All variants that flip bits of one half only keep the other half. They are sent
as one row under that kept half and unfolded where they arrive; a flip of the
kept half itself is a row of its own. That is 50 rows a fingerprint instead of
561, and halves where a single fingerprint arrives need no unfolding at all. All
members of a variant are linked to one member within one flip of it (distance at
most 3 by construction, checked again): linear in a group's size, and no link's
connection is lost.

``near_copies`` is for texts whose sets of five-word shingles are similar by 0.8
or more. Its first candidates are those whose fingerprints, of these sets, are
within 3 bits. That sees similarities above about 0.98; for the rest, sets that
are in no common group yet meet on bands of minima of the same hashes (MinHash),
which depend on the similarity alone and not on where a text was edited. All
candidates are verified by their exact similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudloom.llm.columns import quoted, whole_row
from cloudloom.llm.memory import give_back
from cloudloom.llm.words import bit_majority, lower_words, shingles
from cloudloom.operators.components import connected_components
from cloudloom.workspace import materialise, partitions_for, release, superseded

SEED = 42
#: Rows sent for a fingerprint on average, rows a task takes in, variants it unfolds at a time.
ROWS_EACH, ROWS_A_TASK, UNFOLD = 50, 2e6, 2_000_000
ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)
HALF_FLIPS = np.stack([np.concatenate(([np.uint64(0)], ONE[h : h + 32])) for h in (0, 32)])
HALF_PAIRS = np.stack([np.array([ONE[i] | ONE[k] for i in range(h, h + 32) for k in range(i + 1, h + 32)], np.uint64) for h in (0, 32)])
LOW32 = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)
#: near_copies: bands of minima and minima a band (a pair at 0.8 misses all bands once in 9000); how many times as many
#: leads each round has.
BANDS, BAND_ROWS, MORE_LEADS = 30, 6, 4
_XOR, _ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def text_fingerprint(text: str | None, size: int) -> int:
    """64-bit SimHash of a text's word shingles (repeats count), hashed with XXH64 and seed 42; no words give zero."""
    return int(bit_majority(_hashes(shingles(lower_words(text), size))[:, None])[0])


def _hashes(cut: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in cut), np.uint64, len(cut))


def _mixed(hashes: np.ndarray, count: int) -> np.ndarray:
    """(rows x count) further hashes of hashes (splitmix64)."""
    z = hashes[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, count + 1, dtype=np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row: the SimHash as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([text_fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (root, node) that join the same nodes as the given edges do."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, low = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, low[x], low[y])
        np.minimum.at(new, low[y], low[x])
        new = new[new]
        if (new == low).all() and (low[x] == low[y]).all():
            break
        low = new
    away = low != np.arange(len(nodes))
    return nodes[low[away]], nodes[away]


def _emit_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (view, key, fp): key is a kept half and, above it, which half (0 or 1) may be flipped."""
    for b in batches:
        views, every = np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64)
        for i in range(0, len(every), 4096):
            view, fp = views[i : i + 4096], every[i : i + 4096]
            keys, rows = [], []
            for h in (0, 1):
                kept = (fp >> HALF if h == 0 else fp) & LOW32
                keys.append(kept | np.uint64(h << 32))
                rows.append(np.arange(len(fp)))
                far = np.arange(len(fp)) if h == 0 else np.flatnonzero(np.bitwise_count(fp) % 2)  # two flips cost a half of even parity nothing here
                keys.append(((kept[far, None] ^ ONE[:32]) | np.uint64(h << 32)).ravel())
                rows.append(np.repeat(far, 32))
            key, row = np.concatenate(keys), np.concatenate(rows)
            order = np.argsort(row, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array(view[row[order]]), pa.array(key[order].view(np.int64)), pa.array(fp[row[order]].view(np.int64))], ["view", "key", "fp"])


def _unfold(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variant, fp) of received rows, in pieces of about UNFOLD rows that hold all rows of a variant with one half flipped."""
    pieces = max(1, int(len(key) * 300 // UNFOLD) + 1)
    half = (key >> HALF).astype(np.int64)
    kept = np.where(half == 0, fp >> HALF, fp) & LOW32
    here, even = kept == key & LOW32, np.bitwise_count(fp) % 2 == 0
    moved = np.where(half == 0, (fp & LOW32) | (key << HALF), (fp & ~LOW32) | (key & LOW32))
    for piece, h in product(range(pieces), (0, 1)):
        variants, of = [], []
        for rows, flips in ((here & (half == h), HALF_FLIPS[h]), (here & even & (half == h), HALF_PAIRS[h])):
            own = fp[rows]
            for i in range(0, len(own), 4096):
                v = own[i : i + 4096, None] ^ flips
                pick = (_mixed(v.ravel(), 1)[:, 0] % np.uint64(pieces)).reshape(v.shape) == piece if pieces > 1 else np.ones(v.shape, bool)
                variants.append(v[pick])
                of.append(np.broadcast_to(own[i : i + 4096, None], v.shape)[pick])
        far = ~here & (half == h)
        pick = _mixed(moved[far], 1)[:, 0] % np.uint64(pieces) == piece
        variants.append(moved[far][pick])
        of.append(fp[far][pick])
        yield np.concatenate(variants), np.concatenate(of)


def _stars(variant: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each variant's members to the smallest member within one flip of it."""
    far = np.bitwise_count(variant ^ fp) > 1
    order = np.lexsort((fp, far, variant))
    variant, fp, far = variant[order], fp[order], far[order]
    first = np.concatenate(([True], variant[1:] != variant[:-1]))
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    linked = ~far[lead] & (fp != fp[lead])
    a, b = fp[lead][linked], fp[linked]
    close = np.bitwise_count(a ^ b) <= 3
    return a[close], b[close]


def _link_halves(batches: Iterator[pa.RecordBatch], direct: bool) -> Iterator[pa.RecordBatch]:
    """A task's links (view, src, dst) among fingerprints that share a variant: all stars, or a forest that connects the same."""
    got = [tuple(np.asarray(c) for c in b.columns) for b in batches if b.num_rows]
    if not got:
        return
    view, key, fp = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    order = np.lexsort((key, view))
    view, key, fp = view[order], key[order].view(np.uint64), fp[order].view(np.uint64)
    same = (key[1:] == key[:-1]) & (view[1:] == view[:-1])
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
    view, key, fp = view[shared], key[shared], fp[shared]
    for v in np.unique(view):
        ends = [np.empty((0, 2), np.uint64)]
        for variant, of in _unfold(key[view == v], fp[view == v]):
            if len(variant):
                stars = _stars(variant, of)
                ends.append(np.unique(np.stack(stars, 1), axis=0) if direct else np.stack(_forest(*stars), 1))
        a, b = np.concatenate(ends).T
        if not direct:
            a, b = _forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), v, np.int32)), pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(np.ascontiguousarray(b).view(np.int64))], ["view", "src", "dst"])


def fingerprint_links(fps: DataFrame, direct: bool = False) -> DataFrame:
    """``(view, src, dst)`` links that connect all ``fp`` of a view (``view int, fp long``, distinct) within 3 bits.

    ``direct`` links are pairs within 3 bits, the same however rows are placed;
    otherwise they may join ends of chains of such pairs, and are fewer.
    """
    spark = fps.sparkSession
    parts = partitions_for(spark, fps.count() * ROWS_EACH, ROWS_A_TASK)
    sent = fps.select("view", "fp").repartition(parts).mapInArrow(_emit_halves, "view int, key long, fp long")
    return materialise(sent.repartition(parts, "view", "key").mapInArrow(partial(_link_halves, direct=direct), "view int, src long, dst long").distinct(), "links")


def near_fingerprints(fps: DataFrame) -> DataFrame:
    """``(fp, root)`` for the distinct 64-bit ``fp`` that have another within 3 bits; root names the component."""
    links = fingerprint_links(fps.select(F.lit(0).alias("view"), "fp"))
    return connected_components(links).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    Fingerprints of ``size``-word shingles link at 3 or fewer differing bits;
    ``component_id`` is the smallest ``doc_id`` that links reach. Null and
    wordless texts have fingerprint zero and link like any other. Repeated rows
    keep a row each; a row without a ``doc_id`` takes part and gets the component
    of the others, or null if none has an id. Other columns are ignored, an
    empty table gives an empty table.
    """
    prints = materialise(fingerprints(docs, size, id_col, text_col), "fingerprints")
    groups = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "groups")
    near = near_fingerprints(groups)
    joined = groups.join(near, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    lookup = joined.select("fp", "root").join(lows, "root").select("fp", "component_id")
    return prints.join(lookup, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of a text's distinct five-word shingles, ascending."""
    return np.unique(_hashes(shingles(lower_words(text), 5)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each of BANDS runs of BAND_ROWS minima over the hashes; no hashes have no keys."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    least = np.full(len(_ODD), ~np.uint64(0))
    for at in range(0, len(hashes), 512):
        z = (hashes[at : at + 512, None] ^ _XOR) * _ODD
        z ^= z >> HALF
        z *= _FOLD
        np.minimum(least, z.min(0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ row) * _FOLD
        key ^= key >> np.uint64(29)
    return key


def _text_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, cid, n, fp, bands): the name, size and fingerprint of a text's set of shingles and its band keys."""
    for b in batches:
        names, sizes, prints, bands = [], [], [], []
        for t in b.column(1):
            cut = shingle_set(t.as_py())
            names.append(xxhash.xxh3_64_intdigest(cut.tobytes()))
            sizes.append(len(cut))
            prints.append(bit_majority(cut[:, None])[0])
            bands.append(band_keys(cut).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], ["rid", "cid", "n", "fp", "bands"])
    give_back()


def _text_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, cut): the set of shingles of every text."""
    for b in batches:
        cuts = [shingle_set(t.as_py()).view(np.int64) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cuts, pa.list_(pa.int64()))], ["cid", "cut"])
    give_back()


def near_copies(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``(rid, root)``: rows of ``docs`` by the distinct key ``id_col`` (long), and the smallest key of their group.

    Groups are components of links between texts whose sets of five-word shingles
    have a Jaccard similarity of 0.8 or more, computed exactly. Candidates have
    fingerprints within 3 bits or share one of BANDS bands. Texts with equal sets of shingles always link; texts without
    words are equal to each other. Every row appears, alone in its group if it has no copy.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("rid"), quoted(text_col).cast("string").alias("text"))
    with superseded() as keep:
        prints = materialise(rows.mapInArrow(_text_bands, "rid long, cid long, n long, fp long, bands array<long>"), "bands")
        # one class for each set of shingles: copies take part once; classes are named by what
        # they hold, so neither the order nor the placing of rows decides which links are looked at
        classes = materialise(prints.groupBy("cid").agg(F.min("rid").alias("low"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")
        close = fingerprint_pairs(classes)
        each = classes.select(F.explode("bands").alias("key"), "cid", "n")
        shared = each.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
        members = materialise(each.join(shared, "key"), "members")
        wanted = members.select("cid").union(close.select("a")).union(close.select("b")).distinct().join(classes.select("cid", F.col("low").alias("rid")), "cid").select("rid", "cid")
        sets = materialise(rows.join(wanted, "rid").select("cid", "text").mapInArrow(_text_sets, "cid long, cut array<long>"), "sets")
        linked = _verified(close, sets)
        roots = connected_components(linked, "a", "b").select(F.col("node").alias("cid"), "root")
        live = materialise(_split(members.join(roots, "cid", "left").select("key", "cid", "n", F.coalesce("root", "cid").alias("root"), F.lit(True).alias("short"))).drop("short"), "live")
        release(members)
        links = linked.select("a", "b").unionByName(_band_links(live, sets))
        grouped = classes.join(connected_components(links, "a", "b"), F.col("cid") == F.col("node"), "left").withColumn("group", F.coalesce("root", "cid"))
        lows = grouped.groupBy("group").agg(F.min("low").alias("root"))
        labelled = grouped.select("cid", "group").join(lows, "group").select("cid", "root")
        keep.append(materialise(prints.select("rid", "cid").join(labelled, "cid").select("rid", "root"), "groups"))
    return keep[0]


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """``(a, b, ra, rb)``: classes ``(cid, fp)`` whose fingerprints are within 3 bits, ``a`` and ``ra`` the smaller.

    A fingerprint's classes are held against the smallest of them, and the smallest of two fingerprints against each other.
    """
    heads = materialise(classes.groupBy("fp").agg(F.min("cid").alias("head")), "heads")
    own = classes.select("cid", "fp").join(heads, "fp").where("cid <> head").select("head", "cid")
    links = fingerprint_links(heads.select(F.lit(0).alias("view"), "fp"), direct=True)
    end = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    across = links.join(end("src"), "src").join(end("dst"), "dst").select("src_head", "dst_head")
    both = own.union(across).select(F.least("head", "cid").alias("a"), F.greatest("head", "cid").alias("b")).distinct()
    return materialise(both.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb")), "close")


def _band_links(live: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)`` links that connect all similar pairs of a band, from the bands' members ``(key, cid, n, root)`` with sets of ``n``.

    A lead of a band is held against its other members; then it leaves and links
    become roots. Members left under two or more roots move from bands to their rare
    shingles, which any two similar ones share, and so on with MORE_LEADS times as
    many leads a round, until no key has two roots. So each two similar members of a
    band were compared or are already in one component: a member that its leads
    refuse isn't lost, and a passage common to many texts doesn't pair them.
    """
    links, tested, turn, live = None, None, 0, live.withColumn("place", F.lit(1)).withColumn("short", F.lit(True))
    while True:
        leads = materialise(_leads(live, turn), "leads")
        pairs = _led(live, leads)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        found = _verified(pairs, sets)
        links = found if links is None else links.unionByName(found)
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        roots = connected_components(found, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("top"))
        rest = live.join(leads.select("key", F.col("lead.cid").alias("cid")), ["key", "cid"], "left_anti").join(roots, "root", "left")
        rest = materialise(rest.select("key", "cid", "n", "place", "short", F.coalesce("top", "root").alias("root")), "rest")
        before, live = live, materialise(_split(rest), "members")
        if turn == 0:
            rare = materialise(_under_rare_shingles(live, sets), "rare")
            release(live)
            live = materialise(_split(rare), "members")
            release(rare)
        release(before, leads, rest)
        if live.isEmpty():
            return links.select("a", "b")
        turn += 1


def _split(live: DataFrame) -> DataFrame:
    """The members of keys that have two or more roots, and a short member."""
    split = live.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("short").alias("some")).where("low < high and some").select("key")
    return live.join(split, "key", "left_semi")


def _under_rare_shingles(live: DataFrame, sets: DataFrame) -> DataFrame:
    """The members under the ``n div 5 + 1`` rarest shingles of their sets, counted over all of them, in place of their keys.

    ``place`` is a shingle's place in its set, ``short`` whether that is among the first
    ``n div 9 + 1``. Two sets similar by 0.8 or more share 4 / 9 of their sizes: 8 / 9 of the
    smaller one and 4 / 5 of the larger. So in any one order of the shingles they meet at a
    short place of the smaller set and at one of these places of the larger. A key also
    says which of two neighbouring classes of sizes it is for, as sizes differ by a quarter at most.
    """
    each = live.select("cid", "n", "root").distinct().join(sets, "cid").select("cid", "n", "root", F.explode("cut").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    placed = each.join(often, "key", "left").withColumn("place", F.row_number().over(Window.partitionBy("cid").orderBy(F.coalesce("often", F.lit(1)), "key")))
    kept = placed.where("place <= n div 5 + 1 and often > 1").withColumn("size", F.floor(F.log(F.col("n")) / math.log(1.25)))
    classed = F.explode(F.array(F.xxhash64("key", "size"), F.xxhash64("key", F.col("size") + 1)))
    return kept.select(classed.alias("key"), "cid", "n", "place", F.expr("place <= n div 9 + 1").alias("short"), "root")


def _leads(live: DataFrame, turn: int) -> DataFrame:
    """Up to ``MORE_LEADS ** turn`` leads of every key's members ``(key, cid, n, place, short, root)``."""
    dealt = live.withColumn("deal", F.pmod(F.xxhash64("cid", F.lit(turn)), F.lit(MORE_LEADS**turn)))
    return dealt.groupBy("key", "deal").agg(F.min(F.struct("cid", "n", "place", "short", "root")).alias("lead")).select("key", "lead")


def _led(live: DataFrame, leads: DataFrame) -> DataFrame:
    """Distinct pairs ``(a, b, ra, rb)`` of leads and members of their key under other roots, ``a`` the smaller.

    Short members meet leads that are no smaller, and short leads meet larger
    members, so members that fill a key's later places only never meet each other.
    Sets whose sizes, or what follows their places in the order of shingles, alone
    rule out a similarity of 0.8 make no pair: it takes 4 / 9 of the two sizes in
    common, and nothing in common comes before the first shingle at which they meet.
    """
    left = "least(n - place, lead.n - lead.place) + 1"
    bound = f"root <> lead.root and least(n, lead.n) * 5 >= greatest(n, lead.n) * 4 and ({left}) * 9 >= (n + lead.n) * 4"
    small = live.where("short").join(leads, "key").where(f"n <= lead.n and {bound}")
    large = live.join(leads.where("lead.short"), "key").where(f"n > lead.n and {bound}")
    ends = small.union(large.select(small.columns)).select(F.struct("cid", "root").alias("x"), F.struct("lead.cid", "lead.root").alias("y"))
    ends = ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    return ends.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with a Jaccard similarity of 0.8 or more."""
    cut = lambda end: sets.select(F.col("cid").alias(end), F.col("cut").alias(f"c{end}"))
    both = pairs.join(cut("a"), "a").join(cut("b"), "b").withColumn("both", F.size(F.array_intersect("ca", "cb")))
    # both / (a + b - both) >= 0.8 in whole numbers
    return materialise(both.where(F.col("both") * 9 >= (F.size("ca") + F.size("cb")) * 4).select("a", "b", "ra", "rb"), "near")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each ``near_copies`` group: that of the smallest id, null ids last.

    Of rows with equal ids one stays. All columns stay, null and empty texts are
    copies of each other, an empty table stays empty.
    """
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("rid"), whole_row(docs).alias("own")), "rows")
    groups = near_copies(rows.select("rid", F.col("own")[text_col].alias("text")), "rid")
    ordered = rows.select("rid", F.struct(F.col("own")[id_col].isNull(), F.col("own")[id_col], F.col("rid")).alias("first"))
    stay = groups.join(ordered, "rid").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid"))
    return rows.join(stay, "rid", "left_semi").select("own.*")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` under the 3-word, 3-bit contract."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
