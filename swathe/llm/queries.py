"""One thin query per training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, html_extract, line_dedup, mixing, near_dedup, ngram_join, packing, repeat_spans, toxicity
from .common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, k=20)


def op3_graph_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.mix(table(spark, sf_dir, "documents"))
    rounded = [F.round(c, 6).alias(c) for c in ("weight", "probability")]
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "topic", "tokens", *rounded, "sampled")


def op7_line_alignment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "removed_lines", "removed_bytes", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    fixed = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(chat.events_of(rows.union(fixed))))


def op9_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.select("doc_id", "held_out", "score", "predicted")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_spans.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_multiprobe_neighbours, op3_graph_near_dedup, op4_best_fit_packing, op5_wrapper_induction, op6_mix_to_targets, op7_line_alignment_dedup, op8_event_sourced_chat, op9_deobfuscated_toxicity, op10_suffix_array_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op6_mix_to_targets": mixing.sql(), "op7_line_alignment_dedup": line_dedup.sql()}
