"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm import decontaminate, linededup, neardup, pieces, quality
from pointlake.llm.common import scope, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rates good stay; the others go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("_p_ge_2") >= quality.KEEP_TAIL).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; n_chars is that of the new text."""
    out = linededup.drop_repeated_lines(docs)
    n = F.when(F.col("_n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id, and of repeated rows of
    that id the one that comes first by its other columns in order (null first). Rows without a doc_id all stay."""
    found = neardup.near_duplicates(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = again.join(gone, "doc_id", "left_anti")
    kept = docs.join(gone, "doc_id", "left_anti")
    if not again.limit(1).count():
        return kept.select(*docs.columns)
    rest = [c for c in docs.columns if c != "doc_id"]
    rows = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("_row"))
    first = rows.select("doc_id", *[F.col("_row").getField(c).alias(c) for c in rest])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; of rows without a doc_id those whose own text holds one."""
    key = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("i"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("t"), F.sha2("text", 256)))
    keyed = docs.withColumn("_key", key)
    found = decontaminate.leaks(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = written(found.select(F.col("doc_id").alias("_key")).distinct())
    return keyed.join(found, "_key", "left_anti").select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; adds `tokens` to the columns of documents."""
    return pieces.encode(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: A trained classifier and a seeded tokenizer are not expressible in SQL; tests/llm/test_pipeline.py compares every stage, on
#: what its predecessor kept, with plain Python over all rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scope() as keep:
            docs = written(stage(spark, docs, sf_dir))
            keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
