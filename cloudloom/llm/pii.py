"""Personal data by patterns, checksums and nearby words, with Spark's own functions only.

Each kind's pattern cuts a text twice, into the pieces between matches (``split``)
and the matches (``regexp_extract_all``); running lengths give the positions in
code points. Luhn and mod-97 run as array aggregates over the few candidates.
Words within ``NEAR`` code points of a match move its score; base kinds always
stay, the added ones (iban, ssn) stay from ``KEEP_FROM`` on.

The patterns are written so that Java's matcher stays linear: repeated groups
are possessive (nothing after them could need less), and a run of characters is
tried from its first one or from the end of the match before only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm.arrays import running
from cloudloom.llm.columns import quoted, unused, whole_row

#: Countries by the characters of their IBANs after country and check digits.
IBAN_REST = {
    11: "NO", 12: "BE", 14: "DK|FI|FK|FO|GL|NL|SD", 15: "MK|SI", 16: "AT|BA|EE|KZ|LT|LU|MN|XK", 17: "CH|CR|HR|LI|LV",
    18: "BG|BH|DE|GB|GE|IE|ME|RS|VA", 19: "AE|GI|IL|IQ|OM|SO|TL", 20: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 21: "LY|PT|ST", 22: "IS|TR",
    23: "BI|DJ|FR|GR|IT|MC|MR|SM", 24: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 25: "BR|EG|PS|QA|UA", 26: "JO|KW|MU|YE", 27: "MT|SC", 28: "LC", 29: "RU",
}
_KNOWN = [rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}" for n, c in IBAN_REST.items()]
#: An IBAN ends where its country's does, whatever word follows; other countries' take all they can.
_IBAN = "|".join([*_KNOWN, rf"(?!{'|'.join(IBAN_REST.values())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"])

#: Fixed patterns by kind, in the order in which spans are listed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: A text without this can't hold the kind; a cheap test before the pattern.
TRIGGER = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Scores of a confirmed match, and words that raise it.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
WORDS_NEAR = {
    "email": "mail|contact|write|courriel|correo|kontakt",
    "ip": "ip|host|server|address|adresse",
    "card": "card|credit|visa|pay|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax|insurance",
}
NEAR, RAISE, KEEP_FROM = 40, 0.3, 0.5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, doubled at every second place from the right, sum to a multiple of ten."""
    twice = lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: twice(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _mod97(iban: Column) -> Column:
    """ISO 13616: the first four characters move to the end, letters count 10 to 35, the number is 1 mod 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 60), F.substring(plain, 1, 4))
    number = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(c.cast("int"))
    step = lambda a, c: (a * F.when(c >= "A", 100).otherwise(10) + number(c)) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    count = F.length(_digits(hit))
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.substring(short(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(count.between(13, 19), _luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    if kind == "iban":
        return _mod97(hit)
    if kind == "ssn":
        return ~hit.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def find_personal_data(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """``docs`` with ``pii``: an array of structs (kind, first, last, score), by kind as listed, then by place.

    ``first`` and ``last`` are code points, the end exclusive. A null or empty
    text gives an empty array, a null ``docs`` column elsewhere doesn't matter,
    every row keeps its own result, and all columns pass through. If ``docs`` has a
    ``pii`` already, that stays and the new column gets underscores behind its name.
    """
    found = _with_spans(docs, text_col, kinds)
    return found.select("own.*", F.col("pii").alias(unused(docs, "pii")))


def _with_spans(docs: DataFrame, text_col: str, kinds: tuple[str, ...]) -> DataFrame:
    """``(own, text, pii)``: the row in one struct, its text and its spans."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    base = ["own", "text"]
    df = docs.select(whole_row(docs).alias("own"), text.alias("text"))
    df = df.select(*base, *[F.struct(F.when(seen, F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).alias("hits"), F.when(seen, F.split("text", PATTERNS[k], -1)).alias("gaps")).alias(k) for k in kinds for seen in [F.col("text").contains(TRIGGER[k]) if k in TRIGGER else F.lit(True)]])
    df = df.select(*base, *[F.when(F.size(f"{k}.hits") > 0, F.col(k)).alias(k) for k in kinds])
    lengths = "transform({0}.hits, (x, i) -> cast(char_length(x) + char_length({0}.gaps[i]) as bigint))"
    df = df.select(*base, *kinds, *[F.expr(f"if({k} is null, null, {lengths.format(k)})").alias(f"{k}_n") for k in kinds])
    df = df.select(*base, *kinds, *[F.expr(f"if({k} is null, null, {running(f'{k}_n', '{} + {}'.format)})").alias(f"{k}_e") for k in kinds])

    def spans(kind: str) -> Column:
        hits, gaps = F.col(f"{kind}.hits"), F.col(f"{kind}.gaps")

        def one(hit: Column, i: Column) -> Column:
            last = F.get(F.col(f"{kind}_e"), i)
            around = F.lower(F.concat_ws(" ", F.right(F.get(gaps, i), F.lit(NEAR)), F.left(F.get(gaps, i + 1), F.lit(NEAR))))
            raised = F.when(around.rlike(rf"(?<![a-z])(?:{WORDS_NEAR[kind]})"), F.lit(RAISE)).otherwise(F.lit(0.0))
            score = F.least(F.lit(1.0), F.round(F.lit(SCORE[kind]) + raised, 2))
            return F.struct(F.lit(kind).alias("kind"), (last - F.length(hit)).alias("first"), last.alias("last"), score.alias("score"), _confirmed(kind, hit).alias("ok"))

        found = F.filter(F.transform(hits, one), lambda s: s["ok"] if kind in BASE else s["ok"] & (s["score"] >= KEEP_FROM))
        bare = F.transform(found, lambda s: F.struct(s["kind"], s["first"], s["last"], s["score"]))
        return F.coalesce(bare, F.expr("cast(array() as array<struct<kind:string,first:bigint,last:bigint,score:double>>)"))

    return df.select(*base, F.concat(*[spans(k) for k in kinds]).alias("pii"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined; empty for none."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind in brackets, in one pass.

    Overlapping spans become one, named by the first. Null texts stay null,
    texts without spans stay as they are, columns and rows are those of ``docs``.
    """
    order = "array_sort(transform(pii, s -> struct(s.first as first, -s.last as back, s.kind as kind)))"
    df = _with_spans(docs, text_col, tuple(PATTERNS)).withColumn("s", F.expr(order))
    df = df.withColumn("last", F.expr("transform(s, x -> -x.back)"))
    df = df.withColumn("past", F.expr(f"if(size(s) = 0, cast(array() as array<bigint>), {running('last', 'greatest({}, {})'.format)})"))
    piece = """transform(s, (x, i) -> if(i = 0 or x.first >= past[i - 1],
        concat(substring(text, int(if(i = 0, 0L, past[i - 1]) + 1), int(x.first - if(i = 0, 0L, past[i - 1]))), '[', upper(x.kind), ']'), ''))"""
    done = F.expr(f"concat(array_join({piece}, ''), substring(text, int(array_max(past) + 1)))")
    own = lambda c: F.col("own")[c]
    return df.select(*[(F.when(F.size("s") > 0, done).otherwise(own(c).cast("string")) if c == text_col else own(c)).alias(c) for c in docs.columns])


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every whole text of ``documents``, with digests of the base kinds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_personal_data(docs).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    of_kind = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    scored = F.array_join(F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["first"], s["score"])), ",")
    return found.select("doc_id", *counts[: len(BASE)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), *counts[len(BASE) :], scored.alias("scored"))
