"""Statistics of count distributions: quartiles, CV, Gini and Moran's I."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ratio, ratio_or_zero

QUEEN = tuple((dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0))
ROOK = ((-1, 0), (1, 0), (0, -1), (0, 1))


def gini(values: DataFrame, keys: Sequence[str], value: str = "n") -> DataFrame:
    """Gini coefficient per key: equal values are counted first, so the ranking runs over the
    distinct values, and a value's ranks are summed in closed form. 0 for a zero sum."""
    runs = values.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_c").over(w), F.lit(0))
    ranks = F.col("_c") * before + F.col("_c") * (F.col("_c") + 1) / 2
    runs = runs.withColumn("_r", F.col("_v") * ranks)
    n, s = F.sum("_c"), F.sum(F.col("_v") * F.col("_c"))
    return runs.groupBy(*keys).agg(F.coalesce(2 * ratio(F.sum("_r"), n * s) - ratio(n + 1, n), F.lit(0.0)).alias("Gini"))


def morans_i(cells: DataFrame, keys: Sequence[str], neighbours: Sequence[tuple[int, int]] = QUEEN) -> DataFrame:
    """Moran's I of ``n`` over the given cells. Neighbours are found by an equi-join on shifted
    cell numbers. Null without variance or without neighbouring pairs."""
    mean = cells.groupBy(*keys).agg(F.avg("n").alias("_m"))
    dev = cells.join(mean, list(keys)).select(*keys, "row", "col", (F.col("n") - F.col("_m")).alias("_d"))
    shifts = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in neighbours]))
    moved = dev.withColumn("_s", shifts).select(*keys, (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"), F.col("_d").alias("_e"))
    cross = dev.join(moved, [*keys, "row", "col"]).groupBy(*keys).agg(F.sum(F.col("_d") * F.col("_e")).alias("_cross"), F.count("*").alias("_w"))
    own = dev.groupBy(*keys).agg(F.sum(F.col("_d") * F.col("_d")).alias("_ss"), F.count("*").alias("_n"))
    i = ratio(F.col("_n"), F.col("_w")) * ratio(F.col("_cross"), F.col("_ss"))
    return own.join(cross, list(keys), "left").select(*keys, i.alias("MoranI"))


def summary_statistics(counts: DataFrame, support: DataFrame, keys: Sequence[str], neighbours: Sequence[tuple[int, int]] = QUEEN) -> DataFrame:
    """ncells, Q1, Q2, Q3, IQR, Mean, N, CR, CV, Gini, MoranI per key. ``support`` gives N for a
    subset of the keys (or has one row). Keys of the support without points get zeros and a null
    MoranI when ``support`` has all keys."""
    cells = counts.where("n > 0")
    base = cells.groupBy(*keys).agg(
        F.count("*").alias("ncells"),
        F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        F.avg("n").alias("Mean"),
        F.stddev_samp("n").alias("_sd"),
    )
    on = [c for c in keys if c in support.columns]
    base = base.join(support, on, "right" if len(on) == len(keys) else "inner") if on else base.crossJoin(F.broadcast(support))
    out = base.join(gini(cells, keys), list(keys), "left").join(morans_i(cells, keys, neighbours), list(keys), "left")
    zero = F.lit(0.0)
    q = [F.coalesce(F.col("_q")[i], zero) for i in range(3)]
    return out.select(
        *keys,
        F.coalesce("ncells", F.lit(0)).cast("long").alias("ncells"),
        q[0].alias("Q1"),
        q[1].alias("Q2"),
        q[2].alias("Q3"),
        (q[2] - q[0]).alias("IQR"),
        F.coalesce("Mean", zero).alias("Mean"),
        F.col("N").cast("long").alias("N"),
        ratio_or_zero(F.coalesce("ncells", F.lit(0)), F.col("N")).alias("CR"),
        F.when(F.col("ncells").isNull(), zero).otherwise(ratio(F.col("_sd"), F.col("Mean"))).alias("CV"),
        F.coalesce("Gini", zero).alias("Gini"),
        "MoranI",
    )


def cover_stats_table(counts: DataFrame, support: DataFrame, keys: Sequence[str], pretty: bool = False, add_uniformity: bool = True) -> DataFrame:
    """The same table over class-raster masks; an empty cover has NaN instead of 0 for CV and
    Gini. ``pretty`` rounds to four digits."""
    out = summary_statistics(counts, support, keys)
    nan = F.lit(float("nan"))
    out = out.withColumns({c: F.when(F.col("ncells") == 0, nan).otherwise(F.col(c)) for c in ("CV", "Gini")})
    if not add_uniformity:
        out = out.drop("CV", "Gini", "MoranI")
    if pretty:
        out = out.select(*[F.round(c, 4).alias(c) if t == "double" else c for c, t in out.dtypes])
    return out
