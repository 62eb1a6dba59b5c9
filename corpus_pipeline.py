"""Corpus preparation: five stages over documents, each written as Parquet and reread as the next one's docs.

Every stage works on all rows that the one before kept and returns the columns
of ``documents``; the last returns ids and digests. Nulls, empty and repeated
rows and further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import bpe, decontaminate, pii, quality, simhash
from cloudloom.workspace import materialise, superseded


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose votes make good quality likelier than bad, and that pass the base filter."""
    judged = quality.score_quality(docs, docs.columns).where("kept")
    return judged.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles similar by 0.8 or more."""
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind; ``n_chars`` stays that of the original text."""
    return pii.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id", "lang", "source"])
    return out.withColumnsRenamed({"k0": "doc_id", "k1": "lang", "k2": "source"})


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_redaction", pii_redaction),
    ("byte_bpe", byte_bpe),
]
#: SQL can't express the fitting, the fingerprints or the tokenizer: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's rows are written and reread, its other tables deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with superseded() as keep:
            docs = materialise(stage(spark, docs, sf_dir), name)
            keep.append(docs)
    return docs
