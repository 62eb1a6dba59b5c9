import hashlib
import random
import re

import pytest
from cloudloom.llm import pii

#: The contract's patterns, as plain text.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


FIXED = [
    None, "", " ", "x", "a@b.c-d_e@f.g a@b..c @x.y", "1.2.3.4.5.6.7.8 000255.1.1.1 256.1.1.1 99999999999999999999.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111 1111 1111 1112 é😀 4111111111111111", "+1 (212) 555-0100 ++1 555 0100 99 +49.30.1234567",
    "+4111 1111 1111 1111", "mail a@b.co" * 300, "1 " * 5000, "a" * 30000, "1" * 30000, "a." * 9000 + "@" + "b." * 9000 + "c", "+" + "1 " * 3000,
]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    texts = FIXED + ["".join(rng.choice("ab1 2.@+-(é😀)3") for _ in range(rng.randrange(80))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return texts, df


def test_base_spans_are_those_of_the_plain_patterns(rows):
    texts, df = rows
    for r in pii.find_personal_data(df).collect():
        got = [(s.kind, s.first, s.last) for s in r.pii if s.kind in pii.BASE]
        assert got == brute(texts[r.doc_id]), texts[r.doc_id][:80]


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32.", "GB83 WEST 1234 5698 7654 32", "token 9233A8ECF7C5B09FE5949719B6B82BC4", "social security 219-09-9999", "part 219-09-9999 here", "ssn 000-12-3456"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.first : s.last]) for s in r.pii if s.kind not in pii.BASE] for r in pii.find_personal_data(df).collect()}
    assert got == {0: [("iban", "GB82 WEST 1234 5698 7654 32")], 1: [], 2: [], 3: [("ssn", "219-09-9999")], 4: [], 5: []}


def test_ibans_end_where_their_country_says(spark):
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    texts = [f"{de} BIC COBADEFF", f"{de} 2024-01-01", f"to {gb} 19 OK", f"{de} {gb} {de}", de.replace(" ", "") + " A1", f"{de}0", f"{de[:-1]}1 BIC"]
    want = [[de], [de], [gb], [de, gb, de], [de.replace(" ", "")], [], []]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][s.first : s.last] for s in r.pii if s.kind == "iban"] for r in pii.find_personal_data(df).collect()}
    assert [found[i] for i in range(len(texts))] == want
    # digits of an IBAN may be a card's as well, so the span's name alone is left to the merge
    assert all(x not in r.text for r in pii.redact(df).collect() for x in want[r.doc_id])


def test_redaction_replaces_merged_spans(rows, spark):
    texts, df = rows
    spans = {r.doc_id: sorted((s.first, -s.last, s.kind) for s in r.pii) for r in pii.find_personal_data(df).collect()}
    extra = df.selectExpr("doc_id as pii", "text", "doc_id", "'x' as _s2")
    for r in pii.redact(extra).collect():
        text, out, at = texts[r.doc_id], "", 0
        for first, back, kind in spans[r.doc_id]:
            if first >= at:
                out += text[at:first] + f"[{kind.upper()}]"
            at = max(at, -back)
        assert r.text == (None if text is None else out + text[at:])


def test_query_columns_and_digest(spark, tmp_path, rows):
    texts, df = rows
    df.selectExpr("doc_id", "text", "1 as pii", "2 as spans").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op5_pii_spans(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal_data(df).collect() == [] and pii.redact(df).collect() == []
