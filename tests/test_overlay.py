"""Consensus lines and the choice of references against painting line by line."""

import random

from cloudloom.operators import overlay
from pyspark.sql import functions as F

KEYS = ["f"]


def painted_by_hand(lines, earlier):
    """Each line in turn takes the azimuths behind its first one up to its last."""
    out = []
    for r in earlier:
        line = lines[r]
        front, back = line[0][0], line[-1][0]
        at = next((i for i, p in enumerate(out) if front < p[0]), len(out))
        on = next((i for i in range(at, len(out)) if back < out[i][0]), at)
        # as the erased stretch ends at the first point behind, or nowhere
        on = on if any(back < p[0] for p in out[at:]) else len(out)
        out[at:on] = [(x, d, r) for x, _, d in line]
    return out


def chosen_by_hand(ref, line, across, jump):
    out = {}
    for j in range(len(line) - 1):
        left = sum(x <= line[j][0] for x, _, _ in ref) - 1
        if left < 0 or left + 1 >= len(ref) or line[j][0] - ref[left][0] > across:
            continue
        right = left + 1
        while right < len(ref) and ref[right][0] < line[j + 1][0]:
            right += 1
        if right >= len(ref) or ref[right][0] - line[j + 1][0] > across:
            continue
        ul, um, ur, bl, then = ref[left][1], ref[right - 1][1], ref[right][1], line[j][2], line[j + 1][2]
        kind = depth = None
        if max(abs(ur - ul), abs(ur - bl), abs(ul - bl)) > jump:
            a, b, c, d = (abs(v - then) for v in (ul, um, ur, bl))
            kind, depth = ("UL", ul) if a < min(b, c, d) else ("UM", um) if b < min(c, d) else ("UR", ur) if c < d else ("BL", bl)
        out[j] = kind, depth
    return out


def made(seed):
    rng, lines = random.Random(seed), []
    for _ in range(40):
        at, z = rng.randrange(200), rng.randrange(12)
        line = []
        for _ in range(rng.randrange(1, 40)):
            line.append((at, z, rng.choice((10, 11, 12, 40, 41, 90))))
            at += rng.choice((0, 1, 1, 2, 5)) if rng.random() < 0.2 else rng.randrange(1, 4)
        lines.append(line)
    lines.sort(key=lambda line: (line[0][1], line[0][0]))
    return lines


def test_equals_painting_line_by_line(spark):
    frames = {f: made(f) for f in range(3)}
    rows = [(f, i, t, x, z, d) for f, lines in frames.items() for i, line in enumerate(lines) for t, (x, z, d) in enumerate(line)]
    points = spark.createDataFrame(rows, "f int, name int, t int, qxy int, qz int, qdepth int")
    ranked, spans = overlay.ranked_lines(points, KEYS, ["name"], "t")
    assert {(r.f, r.rank, r.name) for r in spans.collect()} == {(f, i + 1, i) for f in frames for i in range(40)}
    pairs = overlay.references(spans.withColumn("reach", F.lit(3)), KEYS, "reach").cache()
    got = {}
    painted = overlay.consensus(ranked, spans, KEYS, pairs).cache()
    for r in sorted(painted.collect(), key=lambda r: r.place):
        got.setdefault((r.f, r.rank - 1), []).append((r.qxy, r.qdepth, r.ref - 1))
    want, choices, kinds = {}, {}, set()
    for f, lines in frames.items():
        for c, line in enumerate(lines):
            ref = painted_by_hand(lines, [r for r in range(c) if line[0][1] - lines[r][0][1] <= 3])
            if ref:
                want[f, c] = ref
            for j, v in chosen_by_hand(ref, line, 3, 15).items():
                choices[f, c, j] = v
                kinds.add(v[0])
    assert got == want
    found = overlay.predicted_from(ranked.withColumns({"across": F.lit(3), "jump": F.lit(15)}), painted, KEYS, "across", "jump").collect()
    assert {(r.f, r.rank - 1, r.j): (r.kind, r.ref_qdepth) for r in found} == choices
    assert kinds == {None, *overlay.KINDS}


def test_runs_and_tolerant_order(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 5e-7, 4.0), (1, 1.2e-6, 3.0), (1, 3e-6, 1.0), (1, 1.0, 9.0), (2, 0.5, 1.0)], "k int, a double, b double")
    got = overlay.tolerant_order(df, ["k"], "a", "b").collect()
    assert [(r.k, r.b) for r in sorted(got, key=lambda r: (r.k, r.place))] == [(1, 3.0), (1, 4.0), (1, 5.0), (1, 1.0), (1, 9.0), (2, 1.0)]
    assert [r.run for r in overlay.runs(df, ["k"], "a", 0.4).orderBy("k", "a").collect()] == [0, 0, 0, 0, 1, 0]
    assert overlay.runs(df.where("false"), ["k"], "a", 1.0).count() == 0
