"""Users' columns of any name stay as they are."""

import corpus_pipeline
import public_tokenizers
from cloudloom.llm import audit, decontaminate, exact, lexical, pii, sharding, simhash, simple8b, unigram

NAMES = ["pii", "_email", "email", "own", "s", "_s", "last", "past", "_rid", "rid", "cid", "root", "bands", "first", "row", "_row", "a.b", "k0", "TEXT2", "shard"]
TEXTS = [None, "", "write to a.b@c.org", "the same five words twice", "the same five words twice"]


def rows_of(spark):
    rows = [(i, t, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(TEXTS)]
    fields = ", ".join(f"`{n}` string" for n in NAMES)
    return rows, spark.createDataFrame(rows, f"doc_id long, text string, {fields}")


def test_redaction_keeps_every_column(spark):
    rows, df = rows_of(spark)
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(r[0], r[1] and r[1].replace("a.b@c.org", "[EMAIL]"), *r[2:]) for r in rows]
    found = pii.find_personal_data(df)
    assert found.columns == [*df.columns, "pii_"]
    assert {r.doc_id: (r.pii, len(r.pii_)) for r in found.collect()} == {i: (f"pii{i}", int(i == 2)) for i in range(5)}


def test_near_copies_and_leaks_keep_every_column(spark):
    rows, df = rows_of(spark)
    got = simhash.drop_near_copies(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted((rows[0], rows[2], rows[3]))
    bench = spark.createDataFrame([(1, "the same five words twice")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]


def test_shards_keep_every_column(spark, tmp_path):
    rows, df = rows_of(spark)
    sharding.write_shards(df, f"{tmp_path}/out", 20)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.columns == [*df.columns, "shard_"] and sorted(map(tuple, back.drop("shard_").collect()), key=lambda r: r[0]) == rows


def test_stages_keep_every_column(spark, tmp_path):
    _, df = rows_of(spark)
    spark.createDataFrame([(1, "nothing like it at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.schema[2].dataType == df.schema[2].dataType, name
        assert out.count() == {"quality_rules": 0, "near_dedup": 3}.get(name, 5)


def test_columns_may_have_dots(spark, tmp_path):
    rows = [(3, "a b c d e f"), (1, None), (2, "a b c d e f")]
    df, plain = spark.createDataFrame(rows, "`doc.id` long, `the.text` string"), spark.createDataFrame(rows, "doc_id long, text string")
    names = {"id_col": "doc.id", "text_col": "the.text"}
    listed = lambda d: sorted(map(tuple, d.collect()))
    assert listed(simhash.near_duplicates(df, 3, **names)) == listed(simhash.near_duplicates(plain))
    assert listed(simhash.near_copies(df, "doc.id", "the.text")) == [(1, 1), (2, 2), (3, 2)]
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    simple8b.write_token_files(df, spec, f"{tmp_path}/ids", **names)
    assert [r.doc_id for r in sorted(simple8b.read_token_files(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.start)] == [1, 2, 3]
    pieces = [("\u2581a", -1.0), ("\u2581b", -1.0), ("\u2581", -2.0), ("a", -3.0)]
    assert listed(unigram.count_tokens(df, pieces, ["doc.id"], "the.text")) == listed(unigram.count_tokens(plain, pieces, ["doc_id"]))
    assert listed(exact.exact_groups(df, **names).select("doc_id", "keep_id", "kept")) == [(1, 1, True), (2, 2, True), (3, 2, False)]
    items = spark.createDataFrame([(7, "c")], "`item.id` long, `item.text` string")
    assert listed(lexical.search(df, items, 10, "item.id", "item.text", **names).select("item_id", "doc_id")) == [(7, 2), (7, 3)]
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    assert audit.failures(df.withColumn("la.ng", audit.F.lit("x")), labels, "la.ng", "doc.id", "the.text").agg({"n": "sum"}).first()[0] == 3
