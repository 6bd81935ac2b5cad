"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.llm import line_dedup, mixing, ngram_join, packing
from swathe.llm import toxicity as toxic
from swathe.llm.common import materialize, table
from swathe.session import ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    ship_package(spark)
    return toxic.score(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def line_alignment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks leave the later document; one that has nothing left goes."""
    ship_package(spark)
    cut = line_dedup.dedup_lines(docs)
    bare = F.length(F.trim(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("")))) == 0
    cut = cut.where(~((F.col("removed_lines") > 0) & bare))
    return cut.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id stays."""
    ship_package(spark)
    later = ngram_join.jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(materialize(later, "later"), "doc_id", "left_anti").select(*docs.columns)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.where("doc_id is null"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by calibrated probabilities."""
    return mixing.mix(docs).where("sampled").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left, packed into sequences."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_alignment", line_alignment),
    ("ngram_jaccard", ngram_jaccard),
    ("mixing_to_targets", mixing_to_targets),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither alignment, decoding nor packing; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
