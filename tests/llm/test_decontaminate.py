import random
from collections import Counter

import numpy as np
import pytest
from cloudloom.llm import decontaminate as d


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def cut(text):
    w = d.plain_words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(text, item):
    """Best weighted similarity of any span of the item's length."""
    there, want = cut(text), Counter(cut(item))
    n, best = want.total(), 0.0
    for s in range(max(1, len(there) - n + 1)) if want else ():
        span = Counter(there[s : s + n])
        both = sum((span & want).values())
        best = max(best, both / (span.total() + n - both))
    return best


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(1)
    items = [(i, words(rng, n)) for i, n in enumerate((4, 5, 6, 9, 16, 24, 40, 60, 130))] + [(90, None), (91, ""), (92, "x x x x x x x")]
    docs = [None, "", "a b", words(rng, 300), words(rng, 9000)]
    for _, t in items:
        if t:
            docs += [t, t.upper() + "!!", f"{words(rng, 50)} ({t.replace(' ', ', ')}) {words(rng, 50)}", words(rng, 7) + "\n" + t]
            w = t.split()
            for edits in (1, 2, 6):
                v = list(w)
                for _ in range(edits):
                    v[rng.randrange(len(v))] = "changed"
                docs.append(f"{words(rng, 20)} {' '.join(v)} {words(rng, 20)}")
            docs.append(" ".join(w[: len(w) // 2]))
    return items, docs


def test_leaks_are_the_spans_of_high_similarity(cases):
    items, docs = cases
    got = list(d.Index(items).leaks(docs))
    assert len(got) == len(docs)
    missed = 0
    for text, found in zip(docs, got, strict=True):
        want = {i: s for i, t in items if (s := brute(text or "", t or "")) >= d.SIMILAR}
        assert all(abs(want[i] - s) < 1e-12 for i, s, _, _ in found)
        missed += len(want) - len(found)
        assert {i for i, s in want.items() if s == 1} <= {i for i, *_ in found}
    assert missed <= 1


def test_tables_let_everything_within_the_radius_through():
    rng = np.random.default_rng(2)
    index = d.Index([(i, words(random.Random(i), 30)) for i in range(40)])
    (span,) = index.spans
    rows = index.rows[span][0]
    fps = np.repeat(rows, 200)
    for _ in range(d.RADIUS):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64))
    w, r = index.within(span, fps[:, None].view(np.uint8))
    want = np.argwhere(np.bitwise_count(fps[:, None] ^ rows[None, :]) <= d.RADIUS)
    assert sorted(zip(w.tolist(), r.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_many_items_are_looked_up_by_their_blocks(monkeypatch):
    """4096 items: every candidate within the radius is found, and few others are compared."""
    rng, plain = np.random.default_rng(4), random.Random(6)
    index = d.Index([(i, words(plain, 30)) for i in range(4096)])
    (span,) = index.spans
    rows = index.rows[span][0]
    fps = np.concatenate((rng.integers(0, 1 << 63, 1500).astype(np.uint64) * np.uint64(2), rng.choice(rows, 500)))
    for k in range(d.RADIUS):
        fps[1500 + 30 * k :] ^= np.uint64(1) << rng.integers(0, 64, len(fps) - 1500 - 30 * k).astype(np.uint64)
    compared = []
    count = np.bitwise_count
    w, r = index.within(span, fps[:, None].view(np.uint8))
    starts = [x for x, _ in index.lists[span]]
    for k, block in enumerate(fps.view(np.uint16).reshape(-1, 4).T.astype(int)):
        compared.append((starts[k][block + 1] - starts[k][block]).sum())
    want = np.argwhere(count(fps[:, None] ^ rows[None, :]) <= d.RADIUS)
    assert len(want) >= 400 and sorted(zip(w.tolist(), r.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))
    assert sum(compared) < 0.06 * len(fps) * len(rows)


def test_recall_from_four_fifths_on():
    rng, vocab = random.Random(8), [words(random.Random(i), 1) for i in range(3000)]
    items = [(i, words(rng, rng.randrange(14, 60))) for i in range(60)]
    index, texts, wanted = d.Index(items), [], []
    for _ in range(1200):
        i, t = rng.choice(items)
        w = t.split()
        at, m = rng.randrange(len(w)), max(1, int(len(w) * rng.uniform(0.02, 0.2)))
        kind = rng.randrange(4)
        new = [rng.choice(vocab) for _ in range(m)]
        w = [w[:at] + new + w[at + m :], w[:at] + new[:3] + w[at:], w[:at] + w[at + m :], [rng.choice(vocab) if rng.random() < 0.04 else x for x in w]][kind]
        text = [rng.choice(vocab) for _ in range(40)] + w + [rng.choice(vocab) for _ in range(40)]
        hashes, item = d.shingle_hashes(d.plain_words(" ".join(text))).tolist(), Counter(d.shingle_hashes(d.plain_words(t)).tolist())
        best = 0.0
        for first in range(30, 60):
            there = Counter(hashes[first : first + item.total()])
            both = (there & item).total()
            best = max(best, both / (there.total() + item.total() - both))
        texts.append(" ".join(text))
        wanted.append((i, best))
    found = [any(x[0] == i for x in got) for got, (i, _) in zip(index.leaks(texts), wanted, strict=True)]
    near = [f for f, (_, best) in zip(found, wanted, strict=True) if best >= 0.8]
    assert len(near) > 100 and sum(near) >= 0.98 * len(near)


def test_window_fingerprints_match_plain_sums():
    hashes = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64)
    got = {(s, at + i): int(f) for s, at, fps in d.window_fingerprints(hashes, [1, 6, 40]) for i, f in enumerate(fps.view(">u8").ravel())}
    assert len(got) == 5000 + 4995 + 4961
    for s, i in [(1, 0), (6, 2047), (6, 4994), (40, 4960), (40, 2040)]:
        bits = [sum(int(h) >> k & 1 for h in hashes[i : i + s]) > s // 2 for k in range(64)]
        assert got[s, i] == sum(b << k for k, b in enumerate(bits))


@pytest.mark.parametrize("span", [255, 256, 70000])
def test_windows_longer_than_a_lane_of_bits(span):
    hashes = np.random.default_rng(5).integers(0, 1 << 63, span + 3).astype(np.uint64) | np.uint64(1)
    ((_, _, fps),) = d.window_fingerprints(hashes, [span])
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    for i, fp in enumerate(fps):
        assert np.array_equal(np.unpackbits(fp), bits[i : i + span].sum(0, dtype=np.int64) > span // 2)


def test_rows_passes_and_odd_columns(spark, cases, monkeypatch):
    items, docs = cases
    df = spark.createDataFrame([(i, t, 1, None) for i, t in enumerate(docs)] + [(None, docs[13], 1, None)], "doc_id long, text string, item_id int, similarity string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(str, d.find_leaks(df, bench, ["doc_id", "item_id"]).collect()))
    monkeypatch.setattr(d, "ITEMS_A_PASS", 3)
    assert once == sorted(map(str, d.find_leaks(df, bench, ["doc_id", "item_id"]).collect()))
    bad = {r.k0 for r in d.find_leaks(df, bench, ["doc_id"]).collect()}
    kept = d.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(docs)) if i not in bad]
    assert None in bad


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert d.find_leaks(df, bench, ["doc_id"]).collect() == [] and d.find_leaks(some, bench, ["doc_id"]).collect() == []
    assert d.drop_contaminated(some, bench).count() == 1
