"""How filters overlap: what each removes in every order, alone, in vain, and by Shapley's fair share.

Nothing is filtered order by order. One aggregation counts, for each of the 32
sets of five filters, the documents that fail all of the set: a sum of products
of flags. These joint counts say everything. Möbius inversion gives the
documents that fail exactly a set, and so survivors and removals after any
filters; the inclusion-exclusion terms are the Harsanyi dividends of the game
"documents removed by a set", so a filter's Shapley value is the sum of its sets'
dividends, each divided by the size of the set.

Whether a text repeats one of a smaller id is a property of its group of equal
texts. Rows of a group differ in their part and labels only, so they are counted
by these before groups meet: a group is a few rows, however many copies it has.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm.columns import quoted

FILTERS = "ABCDE"
ORDERS = " ".join(map("".join, permutations(FILTERS)))
SETS, TURNS = 1 << len(FILTERS), 120
WEIGHTS = ("n", "good", "toxic")
ALL = f"sequence(0, {SETS - 1})"


def text_failures(text: Column) -> list[Column]:
    """Flags (0 or 1) of the filters A to D on a text that isn't null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < 200, F.size(F.array_distinct(words)) * 100 < n * 50, capitals * 100 > F.length(text) * 3, text.rlike(r"[#$%&*|]"))
    return [f.cast("long").alias(k) for k, f in zip(FILTERS, fails, strict=False)]


def failures(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, A, B, C, D, E, n, good, toxic)``: how many documents have these flags, how many of them are labelled good or toxic.

    Null texts and parts are empty ones. E is a text that a smaller id has; a
    null id is smaller than none and comes after none, rows of one id and text
    are equals. A document is good or toxic if any label of its id says so.
    Other columns are ignored, an empty table gives an empty table.
    """
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    flagged = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("same"), *text_failures(F.col("text")))
    said = lambda c: F.max((F.col(c) == 1).cast("long"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    mark = [F.coalesce(c, F.lit(0)).alias(c) for c in WEIGHTS[1:]]
    kind = ["same", "part", *FILTERS[:4], *WEIGHTS[1:]]
    # the join has dealt rows out by id, so rows of one id and text are counted without a shuffle
    each = flagged.join(marks, "doc_id", "left").select("doc_id", *kind[:-2], *mark).groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    kinds = each.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))).alias("placed"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("firsts"))
    lows = kinds.withColumn("least", F.expr("min(low) over (partition by same)"))
    copies = F.expr("coalesce(placed, 0) - if(low = least, firsts, 0)")
    both = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("E"), (F.col("n") - F.col("copies")).alias("n")), F.struct(F.lit(1).cast("long").alias("E"), F.col("copies").alias("n"))))
    split = lows.withColumn("copies", F.coalesce(copies, F.lit(0))).select("part", *FILTERS[:4], both.alias("x"), *WEIGHTS[1:])
    return split.select("part", *FILTERS[:4], "x.E", "x.n", *[(F.col("x.n") * F.col(c)).alias(c) for c in WEIGHTS[1:]])


def joint_failures(flagged: DataFrame) -> DataFrame:
    """``part`` and an array for each weight: at s, the weight of all rows that fail every filter of the set s (A is bit 0)."""

    product = lambda s, w: " * ".join([w, *[k for i, k in enumerate(FILTERS) if s >> i & 1]])
    sums = lambda w: ", ".join(f"sum({product(s, w)})" for s in range(SETS))
    return flagged.groupBy("part").agg(*[F.expr(f"array({sums(w)})").alias(w) for w in WEIGHTS])


def exact_failures(joint: str) -> Column:
    """From joint to exact sets (Möbius inversion): at t, what fails the filters of t and no other."""
    signed = f"{joint}[s] * if(bit_count(s ^ t) % 2 = 0, 1, -1)"
    return F.expr(f"transform({ALL}, t -> aggregate({ALL}, 0L, (a, s) -> a + if(s & t = t, {signed}, 0L)))")


def shapley_values(joint: str) -> Column:
    """Removals of each filter, summed over all orders: its sets' Harsanyi dividends, a set's shared by its members."""
    share = f"{joint}[s] * if(bit_count(s) % 2 = 1, 1, -1) * {TURNS} div bit_count(s)"
    return F.expr(f"transform(sequence(0, {len(FILTERS) - 1}), i -> aggregate({ALL}, 0L, (a, s) -> a + if(shiftright(s, i) & 1 = 1, {share}, 0L)))")


def audit(joint: DataFrame) -> DataFrame:
    """A row for each part, order of filters and step, from a part's joint counts."""
    cells = joint.select("part", F.col("n").alias("joint"), *[exact_failures(w).alias(w) for w in WEIGHTS], shapley_values("n").alias("shares"))
    turns = cells.select("*", F.explode(F.split(F.lit(ORDERS), " ")).alias("filter_order"))
    steps = turns.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = f"instr('{FILTERS}', substr(filter_order, {{}}, 1)) - 1"
    steps = steps.withColumn("f", F.expr(place.format("step"))).withColumn("past", F.expr(f"aggregate(sequence(0, step - 1), 0, (m, i) -> if(i = 0, 0, m | shiftleft(1, {place.format('i')})))"))
    over = lambda w, test: F.expr(f"aggregate({ALL}, 0L, (a, t) -> a + if({test}, {w}[t], 0L))")
    here = "t & past = 0 and shiftright(t, f) & 1 = 1"
    counted = steps.select("*", over("n", "t & (past | shiftleft(1, f)) = 0").alias("kept"), over("n", here).alias("removed"), *[over(w, here).alias(f"{w}_lost") for w in WEIGHTS[1:]])
    return counted.select(
        "part", "filter_order", "step", "kept", "removed", (F.expr("joint[shiftleft(1, f)]") - F.col("removed")).alias("redundant"),
        F.expr("n[shiftleft(1, f)]").alias("unique_fails"), "good_lost", "toxic_lost", F.expr("shares[f]").alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over whole ``documents``, in all 120 orders, for each language."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(joint_failures(failures(docs, labels)))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
f AS (
  SELECT doc_id, part,
    CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT) AS fails
  FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM k a, k b, k c, k d, k e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM o),
m AS (SELECT filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS f,
  CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1))), 0) AS INT) AS past FROM s),
r AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN fails & (past | f) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & past = 0 AND fails & f > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & past > 0 AND fails & f > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & past = 0 AND fails & f > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & past = 0 AND fails & f > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, m GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""
