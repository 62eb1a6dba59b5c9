"""Multi-party dialogues from every participant's point of view.

For each participant of a conversation the dialogue is rendered with that
speaker's turns as the assistant's and everybody else's as those of named users;
the mask holds the places of the assistant's own words, on which to train.
System turns stay system turns and are nobody's point of view.

Turns are ranked within their conversation, and a conversation is gathered in
blocks of ``BLOCK_TURNS`` ranks, once, and then rendered for each participant where
it lies. Ranks come from a range partitioning of the turns without their texts and
the conversations' counts in its partitions, so neither a long conversation, nor
one that holds a third of all rows, nor turns without numbers or with one number,
meet in one row or task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudloom.llm.arrays import running
from cloudloom.llm.columns import quoted
from cloudloom.workspace import materialise

#: Turns of a block, and blocks of a conversation that a task renders for one participant at most.
BLOCK_TURNS, BLOCKS_TOGETHER = 64, 64
SYSTEM, NOBODY = "system", "unknown"
TURN = ["conv", "turn", "speaker", "mark"]


def _plain(c: str) -> Column:
    """A text in which nothing looks like the rendering's own marks."""
    return F.replace(F.replace(c, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's sorted turns with the partition's number and how many of their conversation's come before them in it."""
    part, last, before = TaskContext.get().partitionId(), None, 0
    for b in batches:
        starts = []
        for conv, n in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True):
            if conv != last:
                last, before = conv, 0
            starts.append(before)
            before += n
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(starts, pa.int64())], [*b.schema.names, "part", "start"])


def _ranked(turns: DataFrame) -> DataFrame:
    """Distinct turns ``(conv, turn, speaker, mark, n)`` with ``first``, the rank of the first of their ``n`` rows."""
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartitionByRange(parts, *TURN).sortWithinPartitions(*TURN)
    kind = {f.name: f.dataType.simpleString() for f in turns.schema}["conv"]
    placed = materialise(ordered.mapInArrow(_counted, f"conv {kind}, turn long, speaker string, mark string, n long, part int, start long"), "turns")
    sums = placed.groupBy("conv", "part").agg(F.sum("n").alias("here"))
    before = F.sum("here").over(Window.partitionBy("conv").orderBy("part")) - F.col("here")  # a conversation has a row for each partition here
    offsets = sums.select(F.col("conv").alias("c"), F.col("part").alias("p"), before.alias("before"))
    found = placed.join(offsets, placed.conv.eqNullSafe(offsets.c) & (F.col("part") == F.col("p")))
    return found.select(*TURN, "n", (F.col("start") + F.col("before")).alias("first"))


def render_perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, speaker, block, n_turns, n_masked, rendered, masks)`` for every participant and block.

    Blocks of a point of view, numbered from 0, are its dialogue: ``BLOCK_TURNS``
    turns each, in order of their numbers, then speakers, then their texts' MD5;
    turns without a number come first. Repeated rows are turns of their own.
    ``masks`` lists ``start:end`` code points of the block's rendering. In texts and
    names ``<|`` becomes ``<\\|`` and ``|>`` becomes ``|\\>``, so none can forge a turn.
    A null speaker is ``unknown``, a null text is empty, null conversations are one
    conversation, and one without participants gives no row. Other columns are
    ignored; an empty table gives an empty table.
    """
    rows = turns.select(
        quoted(conv).alias("conv"),
        quoted(turn).cast("long").alias("turn"),
        F.coalesce(quoted(speaker).cast("string"), F.lit(NOBODY)).alias("speaker"),
        F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("mark", F.md5("text"))
    ranked = materialise(_ranked(rows.groupBy(*TURN).agg(F.count("*").alias("n"))), "ranks")
    # a turn's copies lie in one block or several
    spread = ranked.select(*TURN, F.col("first"), (F.col("first") + F.col("n")).alias("stop"), F.explode(F.expr(f"sequence(first div {BLOCK_TURNS}, (first + n - 1) div {BLOCK_TURNS})")).alias("block"))
    low, high = F.greatest("first", F.col("block") * BLOCK_TURNS), F.least("stop", (F.col("block") + 1) * BLOCK_TURNS)
    spread = spread.select(*[F.col(c).alias(f"r_{c}") for c in TURN], "block", low.alias("first"), (high - low).cast("int").alias("copies"))
    texts = rows.groupBy(*TURN).agg(F.first("text").alias("text"))
    same = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in TURN]
    pieces = texts.join(spread, same[0] & same[1] & same[2] & same[3]).select("conv", "block", "first", F.struct(_plain("speaker").alias("name"), "speaker", _plain("text").alias("text")).alias("t"), "copies")
    blocks = pieces.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("first", "t", "copies"))).alias("got"))  # at most BLOCK_TURNS
    blocks = blocks.select("conv", "block", (F.col("block") / BLOCKS_TOGETHER).cast("long").alias("deal"), F.expr("flatten(transform(got, g -> array_repeat(g.t, g.copies)))").alias("turns"))
    lengths = ranked.groupBy("conv").agg(F.max(F.col("first") + F.col("n")).alias("size"))
    who = ranked.where(F.col("speaker") != SYSTEM).select(F.col("conv").alias("c"), F.col("speaker").alias("me")).distinct()
    who = who.join(lengths, who.c.eqNullSafe(lengths.conv)).select("c", "me", F.explode(F.expr(f"sequence(0L, (size - 1) div {BLOCK_TURNS * BLOCKS_TOGETHER})")).alias("d"))
    seen = blocks.join(who, blocks.conv.eqNullSafe(who.c) & (F.col("deal") == F.col("d")))
    head = f"""transform(turns, t -> case when t.speaker = '{SYSTEM}' then '<|system|>\\n'
        when t.speaker = me then '<|assistant|>\\n' else concat('<|user:', t.name, '|>\\n') end)"""
    seen = seen.withColumn("heads", F.expr(head)).withColumn("parts", F.expr("transform(turns, (t, i) -> concat(heads[i], t.text, '<|end|>\\n'))"))
    seen = seen.withColumn("n", F.expr("transform(parts, p -> cast(char_length(p) as bigint))")).withColumn("ends", F.expr(running("n", "{} + {}".format)))
    spans = """filter(transform(turns, (t, i) -> if(t.speaker = me, concat(ends[i] - n[i] + char_length(heads[i]), ':', ends[i] - 1), null)), x -> x is not null)"""
    seen = seen.withColumn("spans", F.expr(spans))
    return seen.select(F.col("conv").alias("conv_id"), F.col("me").alias("speaker"), "block", F.size("turns").cast("long").alias("n_turns"), F.size("spans").cast("long").alias("n_masked"), F.array_join("parts", "").alias("rendered"), F.array_join("spans", ",").alias("masks"))


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every participant's rendering of every conversation."""
    return render_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
t AS (
  SELECT conv_id, speaker, replace(replace(speaker, '<|', '<\\|'), '|>', '|\\>') AS name, replace(replace(text, '<|', '<\\|'), '|>', '|\\>') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, md5(text)) - 1 AS rank FROM r),
who AS (SELECT DISTINCT conv_id AS c, speaker AS me FROM t WHERE speaker <> 'system'),
p AS (
  SELECT conv_id, me, rank // {BLOCK_TURNS} AS block, rank, speaker, text,
         CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = me THEN '<|assistant|>' ELSE '<|user:' || name || '|>' END || chr(10) AS head
  FROM t JOIN who ON c IS NOT DISTINCT FROM conv_id),
q AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS part,
         CAST(sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, me, block ORDER BY rank) AS BIGINT) AS stop
  FROM p)
SELECT conv_id, me AS speaker, block, count(*) AS n_turns, count(*) FILTER (WHERE speaker = me) AS n_masked,
       string_agg(part, '' ORDER BY rank) AS rendered,
       coalesce(string_agg(CAST(stop - 8 - length(text) AS VARCHAR) || ':' || CAST(stop - 1 AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE q.speaker = me), '') AS masks
FROM q GROUP BY conv_id, me, block
"""
