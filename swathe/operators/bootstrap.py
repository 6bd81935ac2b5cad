"""Spatial block bootstrap of coverage ratios.

The grid is cut into square tiles; a replicate draws tiles with replacement. Cells are summed to
tiles once, so a replicate is a lookup of a few tile sums. Draws are counter-based (a digest of
seed, replicate and draw number): the same under any partitioning and in any engine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import ratio


def block_side(nrows: int, ncols: int, frac: float = 0.03) -> int:
    return max(1, min(round(frac * math.sqrt(nrows * ncols)), min(nrows, ncols)))


def n_tiles(nrows: int, ncols: int, side: int) -> int:
    return -(-nrows // side) * -(-ncols // side)


def draws(spark: SparkSession, nboot: int, n_draw: int, tiles: int, seed: int = 42) -> DataFrame:
    """(b, i, tile): the drawn tiles of each replicate."""
    name = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("i").cast("string")))
    tile = F.conv(F.substring(name, 1, 12), 16, 10).cast("long") % tiles
    i = F.explode(F.sequence(F.lit(0), F.lit(n_draw - 1))).alias("i")
    return spark.range(nboot).select(F.col("id").cast("int").alias("b"), i).withColumn("tile", tile)


def tile_sums(cells: DataFrame, keys: Sequence[str], side: int, ncols: int, hits: Sequence[str]) -> DataFrame:
    """(keys, tile, n_mask, hits...) from mask cells with 0/1 columns."""
    per_row = -(-ncols // side)
    tile = (F.floor(F.col("row") / side) * per_row + F.floor(F.col("col") / side)).cast("long")
    return cells.groupBy(*keys, tile.alias("tile")).agg(F.count("*").alias("n_mask"), *[F.sum(h).alias(h) for h in hits])


def _interval(reps: DataFrame, keys: Sequence[str], level: float) -> DataFrame:
    a = (1 - level) / 2
    return reps.where("stat is not null").groupBy(*keys).agg(
        F.percentile("stat", F.array(F.lit(a), F.lit(1 - a))).alias("_q"), F.count("*").alias("nboot"), F.array_sort(F.collect_list("stat")).alias("replicates")
    ).select(*keys, F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"), "nboot", "replicates")


def bootstrap_cr(cells: DataFrame, keys: Sequence[str], nrows: int, ncols: int, nboot: int = 5000, frac: float = 0.03, seed: int = 42, level: float = 0.95, paired: bool = False) -> DataFrame:
    """Percentile intervals of the coverage ratio per key.

    ``cells`` has one row per mask cell with ``hit`` (0/1), or with ``hit_a`` and ``hit_b`` for
    the paired difference, where both share each draw. An empty mask has no row."""
    spark = cells.sparkSession
    hits = ["hit_a", "hit_b"] if paired else ["hit"]
    side = block_side(nrows, ncols, frac)
    tiles = n_tiles(nrows, ncols, side)
    blocks = tile_sums(cells, keys, side, ncols, hits)
    sizes = blocks.groupBy(*keys).agg(F.sum("n_mask").alias("n_all"), *[F.sum(h).alias(f"all_{h}") for h in hits])
    sizes = sizes.withColumn("n_draw", F.greatest(F.lit(1), F.ceil(F.col("n_all") / (side * side))).cast("int"))
    most = sizes.agg(F.max("n_draw")).first()[0]
    names = [*keys, "estimate", "lower", "upper", "level", "nboot", "block_side", "replicates"]
    if most is None:
        return sizes.select(*keys, *[F.lit(None).cast("double").alias(c) for c in ("estimate", "lower", "upper")]).withColumns(
            {"level": F.lit(level), "nboot": F.lit(0), "block_side": F.lit(0), "replicates": F.array().cast("array<double>")}
        ).select(*names)
    drawn = draws(spark, nboot, most, tiles, seed)
    # a tile is joined to the draws that take it; the draw number limits each key to its own size
    taken = drawn.join(blocks.join(sizes, list(keys)), "tile").where("i < n_draw")
    stat = ratio(F.sum("hit_a"), F.sum("n_mask")) - ratio(F.sum("hit_b"), F.sum("n_mask")) if paired else ratio(F.sum("hit"), F.sum("n_mask"))
    reps = taken.groupBy(*keys, "b").agg(stat.alias("stat"))
    whole = ratio(F.col("all_hit_a"), F.col("n_all")) - ratio(F.col("all_hit_b"), F.col("n_all")) if paired else ratio(F.col("all_hit"), F.col("n_all"))
    return (
        sizes.withColumn("estimate", whole)
        .join(_interval(reps, keys, level), list(keys), "left")
        .withColumns({"level": F.lit(level), "block_side": F.lit(side)})
        .select(*names)
    )


def mask_cells(counts: DataFrame, masks: DataFrame, keys: Sequence[str], min_returns: int = 1) -> DataFrame:
    """Every mask cell of every record with its hit: records times their cover's mask."""
    records = counts.select(*keys).distinct()
    hit = counts.select(*keys, "row", "col", (F.col("n") >= min_returns).cast("int").alias("hit"))
    return records.join(masks, "cover").join(hit, [*keys, "row", "col"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def bootstrap_cr_table(counts: DataFrame, masks: DataFrame, keys: Sequence[str], nrows: int, ncols: int, cover_n: DataFrame | None = None, **how) -> DataFrame:
    """Intervals for every record; with ``cover_n(cover, N)`` the point CR uses these sizes."""
    out = bootstrap_cr(mask_cells(counts, masks, keys), keys, nrows, ncols, **how)
    if cover_n is None:
        return out
    hits = counts.where("n > 0").groupBy(*keys).agg(F.count("*").alias("_hits"))
    return out.join(hits, list(keys), "left").join(cover_n, "cover").withColumn("CR", F.coalesce(ratio(F.col("_hits"), F.col("N")), F.lit(0.0))).drop("_hits")


def bootstrap_cr_difference_table(counts: DataFrame, masks: DataFrame, comparisons: DataFrame, nrows: int, ncols: int, **how) -> DataFrame:
    """Paired intervals for ``comparisons(label, ret, cover, mission_a, mission_b)``; a comparison
    without one of its records is skipped. ``significant``: the interval excludes 0."""
    def hits(side: str) -> DataFrame:
        return counts.select("ret", "cover", F.col("mission").alias(f"mission_{side}"), "row", "col", (F.col("n") >= 1).cast("int").alias(f"hit_{side}"))

    known = counts.select("ret", "cover", "mission").distinct()
    present = comparisons
    for side in ("a", "b"):
        present = present.join(known.withColumnRenamed("mission", f"mission_{side}"), ["ret", "cover", f"mission_{side}"], "left_semi")
    cells = present.join(masks, "cover")
    for side in ("a", "b"):
        cells = cells.join(hits(side), ["ret", "cover", f"mission_{side}", "row", "col"], "left").withColumn(f"hit_{side}", F.coalesce(f"hit_{side}", F.lit(0)))
    out = bootstrap_cr(cells, ["label", "ret", "cover", "mission_a", "mission_b"], nrows, ncols, paired=True, **how)
    return out.withColumn("significant", (F.col("lower") > 0) | (F.col("upper") < 0))


def narrative_comparisons(spark: SparkSession, covers=("field", "decid", "conif"), returns=("ground", "all"), guided="density", against=("const2", "const8")) -> DataFrame:
    rows = [(f"{c} {r}: {guided} - {b}", r, c, guided, b) for c in covers for r in returns for b in against]
    return spark.createDataFrame(rows, "label string, ret string, cover string, mission_a string, mission_b string")
