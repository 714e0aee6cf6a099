"""The training-data pipeline.

``STAGES`` are (name, function) in order; each function takes (spark, docs, sf_dir) and works on every row that its
predecessor kept. All but the last return the columns of ``documents``; the last returns the encoded corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trisettle.llm import bytebpe, decontaminate, jaccard, language, pii
from trisettle.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of the main language; documents below it mix languages too evenly to be used.
MAIN_LANGUAGE = 0.4


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; ``lang`` becomes the predicted one. Texts without a letter go."""
    found = language.predict(docs, language.fold_model(docs), *COLUMNS)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MAIN_LANGUAGE)).select(
        "doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.one_of_each(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars counts the new text."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bytebpe.round_trip(docs)


STAGES = [
    ("language", identify),
    ("near_copies", deduplicate),
    ("decontamination", decontaminated),
    ("personal_data", redact),
    ("byte_bpe", encode),
]
#: SQL cannot express these stages; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
