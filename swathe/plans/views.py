"""The domain's relations as views over star-schema tables.

``events`` become points, counts and a track; ``orders`` become waypoints; ``embeddings`` become
features. The same views in SQL are the common table expressions below, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NROWS, NCOLS = 30, 288
COVER_CELLS = NROWS * 96
COVERS = ("field", "decid", "conif")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cover_of(col: str = "col"):
    return F.when(F.col(col) < 96, "field").when(F.col(col) < 192, "decid").otherwise("conif")


def points(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, mission, row, col, x, y, z, cls): one point per event."""
    e = table(spark, d, "events")
    col = F.hour("ts") * 12 + F.floor(F.minute("ts") / 5).cast("int")
    row = F.dayofmonth("ts") - 1
    return e.select(
        "event_id",
        F.col("event_type").alias("mission"),
        row.alias("row"),
        col.alias("col"),
        (col + 0.5).alias("x"),
        (F.lit(NROWS) - row - 0.5).alias("y"),
        F.col("value").alias("z"),
        F.when(F.col("event_id") % 2 == 0, 2).otherwise(1).alias("cls"),
    )


def classes(spark: SparkSession) -> DataFrame:
    from ..operators.raster import grid_cells

    return grid_cells(spark, NROWS, NCOLS).select("row", "col", cover_of().alias("cover"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Sparse (ret, cover, mission, row, col, n)."""
    ret = F.explode(F.when(F.col("cls") == 2, F.array(F.lit("all"), F.lit("ground"))).otherwise(F.array(F.lit("all"))))
    p = points(spark, d).select("mission", "row", "col", ret.alias("ret"))
    return p.groupBy("ret", "mission", "row", "col").agg(F.count("*").alias("n")).withColumn("cover", cover_of())


def dense(spark: SparkSession, d: str) -> DataFrame:
    """(mission, cover, row, col, x, n): all cells of the grid for each mission, all returns."""
    c = counts(spark, d).where("ret = 'all'").select("mission", "row", "col", "n")
    missions = c.select("mission").distinct()
    grid = classes(spark).crossJoin(F.broadcast(missions))  # event types: a handful
    return grid.join(c, ["mission", "row", "col"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "x": F.col("col").cast("double")})


def track(spark: SparkSession, d: str) -> DataFrame:
    """(mission, seq, x, y, ve, vn, time): events in order of time."""
    e = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_type").alias("mission"),
        F.col("event_id").alias("seq"),
        ((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))) / F.lit(216.0)).alias("x"),
        F.col("user_id").cast("double").alias("y"),
        F.col("value").cast("double").alias("ve"),
        (F.col("event_id") % 7).cast("double").alias("vn"),
        (F.unix_micros(ts) / F.lit(1e6)).alias("time"),
    )


def waypoints(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.lit("survey").alias("mission"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderkey") % 400).cast("double").alias("x"),
        (F.lit(40) * (F.col("o_custkey") % 7)).cast("double").alias("y"),
        (F.col("o_totalprice") % 10).cast("double").alias("speed"),
    )


def pixels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.floor(F.col("event_id") / 100).cast("int").alias("row"),
        (F.col("event_id") % 100).cast("int").alias("col"),
        ((F.col("user_id") * 7) % 256).cast("int").alias("r"),
        (F.floor("value") % 256).cast("int").alias("g"),
        (F.hour("ts") * 10).cast("int").alias("b"),
    )


def features(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("f"), F.col("label").cast("int").alias("label"))


PTS = """pts as (select event_id, event_type as mission, day(ts) - 1 as r, hour(ts) * 12 + cast(floor(minute(ts) / 5) as int) as c,
  case when event_id % 2 = 0 then 2 else 1 end as cls, value as z from events)"""
CNT = (
    PTS
    + """,
cnt as (select ret, case when c < 96 then 'field' when c < 192 then 'decid' else 'conif' end as cover, mission, r, c, count(*) as n
  from (select 'all' as ret, * from pts union all select 'ground' as ret, * from pts where cls = 2) group by all)"""
)
CELLS = "cells as (select a.i as r, b.i as c, case when b.i < 96 then 'field' when b.i < 192 then 'decid' else 'conif' end as cover from range(30) a(i), range(288) b(i))"
DENSE = (
    CNT
    + ",\n"
    + CELLS
    + """,
dense as (select m.mission, cells.cover, cells.r, cells.c, coalesce(n, 0) as n from cells cross join (select distinct mission from pts) m
  left join cnt on cnt.ret = 'all' and cnt.mission = m.mission and cnt.r = cells.r and cnt.c = cells.c)"""
)
TRACK = """track as (select event_type as mission, event_id as seq, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 216.0::double as x, user_id::double as y,
  value::double as ve, (event_id % 7)::double as vn, epoch_us(ts) / 1e6 as time from events)"""
WAYPOINTS = "wps as (select 'survey' as mission, o_orderkey as seq, (o_orderkey % 400)::double as x, (40 * (o_custkey % 7))::double as y, (o_totalprice % 10)::double as speed from orders)"
FEATURES = "feat as (select vec_id as id, label, list_transform(embedding, lambda x: x::double) as f from embeddings)"
