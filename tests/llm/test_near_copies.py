import random

from cloudloom.llm import simhash
from cloudloom.llm.words import lower_words, shingles
from cloudloom.operators.components import connected_components


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


def edited(rng, kind, w, share):
    m, at = max(1, int(len(w) * share)), rng.randrange(len(w) * 3 // 4)
    if kind == "block":
        return w[:at] + words(rng, m) + w[at + m :]
    if kind == "append":
        return w + words(rng, m)
    if kind == "delete":
        return w[:at] + w[at + m :]
    return [rng.choice(("other", "words")) if rng.random() < share / 5 else x for x in w]


def similarity(x, y):
    x, y = (set(shingles(lower_words(" ".join(t)), 5)) for t in (x, y))
    return len(x & y) / len(x | y)


def test_every_kind_of_edit_links_from_four_fifths_on(spark):
    rng, rows, wanted = random.Random(9), [], []
    for kind in ("block", "append", "delete", "scattered"):
        for _ in range(60):
            w = words(rng, rng.randrange(80, 600))
            v = edited(rng, kind, w, rng.uniform(0.02, 0.3))
            wanted.append(similarity(w, v) >= 0.8)
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    assert 100 < sum(wanted) < 230
    root = dict(simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect())
    assert [root[2 * i] == root[2 * i + 1] for i in range(len(wanted))] == wanted
    assert all(root[2 * i] == 2 * i for i in range(len(wanted)))


def test_members_that_their_lead_refuses_are_compared_too(spark):
    """One band of 31 members: the smallest resembles nobody, the others form chains of which only neighbours are similar."""
    rng = random.Random(4)
    cut = {0: list(range(10**6, 10**6 + 90))}
    for chain in range(5):
        for k in range(6):
            cut[len(cut)] = list(range(10**4 * chain + 10 * k, 10**4 * chain + 10 * k + 95))
    order = dict(zip(list(cut)[1:], rng.sample(range(1, 31), 30), strict=True)) | {0: 0}
    live = spark.createDataFrame([(7, order[i], len(cut[i]), order[i]) for i in cut], "key long, cid long, n long, root long")
    sets = spark.createDataFrame([(order[i], c) for i, c in cut.items()], "cid long, cut array<long>")
    root = {r.node: r.root for r in connected_components(simhash._band_links(live, sets), "a", "b").collect()}
    groups = [{order[i] for i in range(1 + 6 * chain, 7 + 6 * chain)} for chain in range(5)]
    assert root == {i: min(g) for g in groups for i in g}


def test_similar_sets_meet_at_rare_shingles_and_others_hardly(spark):
    """Edited versions of a few sets and sets around one common passage: all similar pairs are candidates."""
    rng, cut = random.Random(6), {}
    for base in range(5):
        core = rng.sample(range(10**6), rng.randrange(20, 120))
        for _ in range(14):
            kept = [x for x in core if rng.random() > 0.08]
            cut[len(cut)] = sorted(set(kept + rng.sample(range(10**6), rng.randrange(8))))
    passage = rng.sample(range(10**6), 60)
    for _ in range(40):
        cut[len(cut)] = sorted(set(passage + rng.sample(range(10**6), 40)))
    live = spark.createDataFrame([(7, i, len(c), i) for i, c in cut.items()], "key long, cid long, n long, root long")
    sets = spark.createDataFrame([(i, c) for i, c in cut.items()], "cid long, cut array<long>")
    keyed = simhash._under_rare_shingles(live, sets).cache()
    pairs = {(r.a, r.b) for r in simhash._led(keyed, simhash._leads(keyed, 12)).collect()}
    similar = {(i, k) for i in cut for k in cut if i < k and len(set(cut[i]) & set(cut[k])) * 5 >= len(set(cut[i]) | set(cut[k])) * 4}
    assert len(similar) > 100 and similar <= pairs
    assert not any(i >= 70 and k >= 70 for i, k in pairs)


def test_texts_of_one_template_meet_nowhere(spark):
    """A template with a passage of one's own in it, at a similarity of about 0.7: the joins' rows grow with the texts, not with their pairs."""
    rng = random.Random(3)
    base, counts = words(rng, 160), []
    for n in (60, 120):
        cut = {}
        for i in range(n):
            at = rng.randrange(20, 110)
            w = base[:at] + [f"own{i}x{k}" for k in range(22)] + base[at + 22 :]
            cut[i] = simhash.shingle_set(" ".join(w)).view("int64").tolist()
        live = spark.createDataFrame([(7, i, len(c), i) for i, c in cut.items()], "key long, cid long, n long, root long")
        sets = spark.createDataFrame([(i, c) for i, c in cut.items()], "cid long, cut array<long>")
        keyed = simhash._split(simhash._under_rare_shingles(live, sets))
        counts.append(keyed.where("short").join(keyed.select("key", "cid").withColumnRenamed("cid", "other"), "key").count())
    assert counts[1] <= 3 * counts[0] + 50


def test_fingerprints_link_near_copies_before_bands_do(spark, monkeypatch):
    """Without what bands link: long texts with a word or two changed, and others of which fingerprints see nothing."""
    rng, rows = random.Random(12), []
    for i in range(24):
        w = words(rng, 1500)
        v = [x if k not in (300, 900)[: 1 + i % 2] else "changed" for k, x in enumerate(w)] if i < 16 else edited(rng, "block", w, 0.1)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    prints = [int(simhash.bit_majority(simhash.shingle_set(t)[:, None])[0]) for _, t in rows]
    wanted = [(prints[2 * i] ^ prints[2 * i + 1]).bit_count() <= 3 for i in range(24)]
    assert 10 <= sum(wanted) < 24
    monkeypatch.setattr(simhash, "_band_links", lambda live, sets: live.selectExpr("cid a", "cid b").where("false"))
    root = dict(simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect())
    assert [root[2 * i] == root[2 * i + 1] for i in range(24)] == wanted
