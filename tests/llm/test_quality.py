import random
import re
from collections import Counter

import pyarrow.dataset as ds
import pytest
from cloudloom.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def plain_base(text):
    text = text or ""
    words = re.findall(WORD, text)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(wins)
    hit = {k for i, w in enumerate(wins) if many[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_base_statistics_match_plain_definition():
    rng = random.Random(1)
    texts = [None, "", " ", "a", "a\na\n\na ", "É😀 x\x0by", "x " * 40000, "no break"] + [" ".join(rng.choice("ab#é\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    for t in texts:
        assert quality.text_stats(t)[:5] == plain_base(t), t


def test_other_statistics():
    s = dict(zip(quality.STATS, quality.text_stats("AB É cd!! | ab.\nab| 12"), strict=True))
    assert (s["n_upper"], s["n_letters"], s["n_lone"], s["n_marked_words"], s["n_distinct"], s["n_ended"]) == (3, 11, 1, 1, 7, 2)


def test_expectation_maximisation_recovers_planted_accuracies():
    rng = random.Random(4)
    counts = Counter()
    for _ in range(20000):
        good = rng.random() < 0.8
        counts["".join(rng.choice("-") if rng.random() < 0.2 else str(int(good if rng.random() < a else not good)) for a in (0.95, 0.9, 0.85, 0.8, 0.7))] += 1
    share, logs = quality.fit(dict(counts))
    assert abs(share - 0.8) < 0.03 or abs(share - 0.2) < 0.03
    assert quality.posterior(dict(counts))["11111"] > 0.95 > 0.05 > quality.posterior(dict(counts))["00000"]
    assert quality.fit({})[0] == 0.5 and quality.posterior({}) == {}


def test_verdicts_follow_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op8_quality_rules(spark, sf).collect()}
    labels = ds.dataset(f"{sf}/labels.parquet").to_table().to_pylist()
    judged = [(r["quality"], got[r["doc_id"]].kept) for r in labels if not got[r["doc_id"]].base_failed]
    assert sum(q == k for q, k in judged) / len(judged) > 0.97
    texts = ds.dataset(f"{sf}/documents.parquet").to_table().to_pylist()
    for d in texts:
        assert tuple(got[d["doc_id"]])[1:6] == plain_base(d["text"])


@pytest.mark.parametrize("texts", [[], [None], ["", "a b c"] * 3])
def test_odd_tables(spark, texts):
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t in enumerate(texts)], "doc_id long, text string, votes int, posterior double")
    got = quality.score_quality(df, ["doc_id", "votes"]).collect()
    assert len(got) == len(texts) and not any(r.kept for r in got)
