"""Coverage ratios, bin percentages and count grids.

``counts`` tables are sparse: cells without points have no row. Where zeros matter, the number of
cells of the support is given or joined, never materialised.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clamp, ratio_or_zero

DEFAULT_BINS = ((1, 5), (6, 10), (11, 20), (21, 50))
#: Name, lowest and highest count (None: no limit) of the bins of the density table.
DENSITY_BINS = (("0", 0, 0), ("1", 1, 1), (">1–10", 2, 10), ("10–25", 11, 25), (">25", 26, None))


def coverage_ratio(grid: DataFrame, keys: Sequence[str], min_returns: int = 1) -> DataFrame:
    """Share of the cells of a dense grid (column ``n``) with at least ``min_returns``."""
    return grid.groupBy(*keys).agg(F.coalesce(F.avg((F.col("n") >= min_returns).cast("double")), F.lit(0.0)).alias("cr"))


def sparse_coverage(counts: DataFrame, keys: Sequence[str], support: Column | int, min_returns: int = 1) -> DataFrame:
    """The same from sparse counts and the support's size (a number, or a column of ``counts``)."""
    size = F.lit(support) if isinstance(support, int) else F.first(support)
    hits = F.count_if(F.col("n") >= min_returns)
    return counts.groupBy(*keys).agg(hits.alias("ncells"), ratio_or_zero(hits, size).alias("cr"))


def percent_in_bin(lo: int, hi: int, include_zeros: bool = False) -> Column:
    """Aggregate: percentage of cells with lo <= n <= hi, both inclusive, of all nonzero cells
    (or of all cells)."""
    whole = F.count("n") if include_zeros else F.count_if(F.col("n") != 0)
    return 100 * ratio_or_zero(F.count_if(F.col("n").between(lo, hi)), whole)


def density_bin_summary(grid: DataFrame, keys: Sequence[str], bins: Sequence[tuple[int, int]] = DEFAULT_BINS) -> DataFrame:
    """Coverage ratio, mean and median of the positive counts, and a map of bin percentages."""
    positive = F.when(F.col("n") > 0, F.col("n"))
    entries = [x for lo, hi in bins for x in (F.lit(f"bin_{lo}_{hi}"), percent_in_bin(lo, hi))]
    return grid.groupBy(*keys).agg(
        F.coalesce(F.avg((F.col("n") >= 1).cast("double")), F.lit(0.0)).alias("cr"),
        F.coalesce(F.avg(positive), F.lit(0.0)).alias("mean"),
        F.coalesce(F.median(positive), F.lit(0.0)).alias("median"),
        F.create_map(*entries).alias("bins"),
    )


def per_cover_summary(grid: DataFrame, bins: Sequence[tuple[int, int]] = DEFAULT_BINS) -> DataFrame:
    return density_bin_summary(grid, ["cover", "mission"], bins)


def coverage_profile(grid: DataFrame, keys: Sequence[str], axis: str = "x", bin_size: float = 5.0, min_returns: int = 1) -> DataFrame:
    """Coverage ratio per strip along an axis. Strips start at the smallest coordinate and include
    both edges, so a cell on an inner edge counts in two strips."""
    edge = grid.groupBy(*keys).agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"))
    t = (F.col(axis) - F.col("_lo")) / F.lit(bin_size)
    k = F.floor(t).cast("int")
    last = F.greatest(F.lit(0), F.ceil((F.col("_hi") - F.col("_lo")) / F.lit(bin_size)).cast("int") - 1)
    strips = F.when((t == k) & (k > 0), F.array(k - 1, k)).otherwise(F.array(k))
    rows = (grid.join(edge, list(keys)) if keys else grid.crossJoin(F.broadcast(edge))).withColumn("strip", F.explode(strips)).where(F.col("strip") <= last)
    return rows.groupBy(*keys, "strip").agg(
        (F.first("_lo") + (F.col("strip") + 0.5) * F.lit(bin_size)).alias("center"),
        F.avg((F.col("n") >= min_returns).cast("double")).alias("cr"),
        F.count("*").alias("ncells"),
    )


def mask_stats(mask: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Area, share of ``size`` cells and bounding box of a set of cells."""
    return mask.groupBy(*keys).agg(
        F.count("*").alias("area"),
        (F.count("*") / F.lit(size)).alias("frac"),
        *[f(c).alias(f"{c}_{n}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max))],
    )


def density_minmax(grid: DataFrame) -> DataFrame:
    return grid.agg(F.min("z").alias("zmin"), F.max("z").alias("zmax"))


def rescale_density(grid: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """z mapped onto [lo, hi]; a flat surface takes the middle."""
    ends = F.broadcast(density_minmax(grid))  # one row
    share = F.try_divide(F.col("z") - F.col("zmin"), F.col("zmax") - F.col("zmin"))
    z = F.when(F.col("zmin") == F.col("zmax"), F.lit((lo + hi) / 2)).otherwise(clamp(F.lit(lo) + share * F.lit(hi - lo), lo, hi))
    return grid.crossJoin(ends).withColumn("z", z).drop("zmin", "zmax")


def bin_points(points: DataFrame, classes: DataFrame, xmin: float, ymax: float, dx: float, dy: float, nrows: int, ncols: int) -> DataFrame:
    """Counts (mission, kernel, ret, cover, row, col, n) of points (x, y, cls) over a class raster
    (row, col, cover). One pass makes both returns; points outside the grid drop out."""
    row, col = F.floor((F.lit(ymax) - F.col("y")) / dy).cast("int"), F.floor((F.col("x") - F.lit(xmin)) / dx).cast("int")
    cells = points.withColumns({"row": row, "col": col}).where(F.col("row").between(0, nrows - 1) & F.col("col").between(0, ncols - 1))
    keys = [c for c in ("mission", "kernel") if c in points.columns]
    ret = F.explode(F.when(F.col("cls") == 2, F.array(F.lit("all"), F.lit("ground"))).otherwise(F.array(F.lit("all"))))
    return cells.withColumn("ret", ret).groupBy(*keys, "ret", "row", "col").agg(F.count("*").alias("n")).join(classes, ["row", "col"])


def build_cover_masks(counts: DataFrame) -> DataFrame:
    """Union over all records of the cells with points, per cover."""
    return counts.where("n > 0").select("cover", "row", "col").distinct()


def percent_density_table(counts: DataFrame, support: DataFrame, keys: Sequence[str], bins=DENSITY_BINS) -> DataFrame:
    """Percentage of a cover's cells per count bin; ``support(cover, ncover)`` has its cells, so
    empty cells fall in the zero bin."""
    inside = counts.groupBy(*keys).agg(
        F.count_if(F.col("n") > 0).alias("_some"), *[F.count_if((F.col("n") >= max(lo, 1)) & ((F.col("n") <= hi) if hi is not None else F.lit(True))).alias(f"_{i}") for i, (_, lo, hi) in enumerate(bins)]
    ).join(support, "cover")
    cols = []
    for i, (name, lo, _) in enumerate(bins):
        hits = F.col(f"_{i}") + (F.col("ncover") - F.col("_some") if lo <= 0 else F.lit(0))
        cols.append((100 * ratio_or_zero(hits, F.col("ncover"))).alias(name))
    return inside.select(*keys, F.col("ncover").alias("Ncells"), *cols)
