"""Kernel density of a cell mask.

The Gaussian is separable: two one-dimensional passes over few offsets. The Epanechnikov kernel is
a quadratic in the column distance for each row distance, so three prefix sums per row give its
exact value with a cost that does not grow with the bandwidth's square.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def gaussian_weights(sigma: float, d: float = 1.0) -> list[float]:
    """One-dimensional weights for offsets -r..r, with r = ceil(3 sigma / d), summing to 1."""
    r = max(1, math.ceil(3 * sigma / d))
    w = [math.exp(-0.5 * (k * d / sigma) ** 2) for k in range(-r, r + 1)]
    return [v / math.fsum(w) for v in w]


def epanechnikov_offsets(h: float) -> tuple[list[tuple[int, int]], float]:
    """Half width of the disk for each row offset (in cells), and the sum of 1 - r^2 / h^2."""
    if not h > 0:
        raise ValueError("the bandwidth must be positive")
    r = math.ceil(h)
    spans, total = [], []
    for dr in range(-r, r + 1):
        w = -1
        while dr * dr + (w + 1) ** 2 < h * h:
            w += 1
        if w >= 0:
            spans.append((dr, w))
            total += [1 - (dr * dr + c * c) / (h * h) for c in range(-w, w + 1)]
    if not total:
        raise ValueError("the kernel is empty")
    return spans, math.fsum(total)


def scott_sigma(mask: DataFrame, min_cells: float = 2.0, max_cells: float = 50.0, anisotropic: bool = False) -> tuple[float, float]:
    """Bandwidths (x, y) in cells: population deviation times n^(-1/6), within limits."""
    r = mask.agg(F.stddev_pop("col").alias("sx"), F.stddev_pop("row").alias("sy"), F.count("*").alias("n")).first()
    if not r.n:
        raise ValueError("the mask is empty")
    s = [min(max(v * r.n ** (-1 / 6), min_cells), max_cells) for v in (r.sx, r.sy)]
    return (s[0], s[1]) if anisotropic else (sum(s) / 2, sum(s) / 2)


def scott_sigma_indices(mask: DataFrame, min_cells: float = 1.0) -> float:
    """Mean of the sample deviations of rows and columns times n^(-1/6)."""
    r = mask.agg(F.stddev_samp("row").alias("a"), F.stddev_samp("col").alias("b"), F.count("*").alias("n")).first()
    return max(min_cells, ((r.a or 0.0) + (r.b or 0.0)) / 2 * max(r.n, 1) ** (-1 / 6))


def _spread(cells: DataFrame, axis: str, weights: list[float], size: int) -> DataFrame:
    r = len(weights) // 2
    table = F.array(*[F.struct(F.lit(k - r).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
    other = "col" if axis == "row" else "row"
    out = cells.withColumn("_k", F.explode(table)).select(other, (F.col(axis) + F.col("_k.d")).alias(axis), (F.col("z") * F.col("_k.w")).alias("z"))
    return out.where(F.col(axis).between(0, size - 1)).groupBy(other, axis).agg(F.sum("z").alias("z"))


def gaussian_density(mask: DataFrame, nrows: int, ncols: int, sigma_x: float, sigma_y: float | None = None) -> DataFrame:
    """Sparse (row, col, z): the mask convolved with the kernel, zero outside the grid."""
    ones = mask.select("row", "col", F.lit(1.0).alias("z"))
    wide = _spread(ones, "col", gaussian_weights(sigma_x), ncols)
    return _spread(wide, "row", gaussian_weights(sigma_x if sigma_y is None else sigma_y), nrows).select("row", "col", "z")


def epanechnikov_density(mask: DataFrame, cells: DataFrame, h: float) -> DataFrame:
    """Dense (row, col, z) over ``cells(row, col)``."""
    spans, total = epanechnikov_offsets(h)
    dense = cells.select("row", "col").join(mask.select("row", "col", F.lit(1).alias("_m")), ["row", "col"], "left").withColumn("_m", F.coalesce("_m", F.lit(0)).cast("double"))
    parts = []
    for w in sorted({w for _, w in spans}):
        win = Window.partitionBy("row").orderBy("col").rangeBetween(-w, w)
        parts += [F.sum("_m").over(win).alias(f"_0_{w}"), F.sum(F.col("_m") * F.col("col")).over(win).alias(f"_1_{w}"), F.sum(F.col("_m") * F.col("col") * F.col("col")).over(win).alias(f"_2_{w}")]
    sums = dense.select("row", "col", *parts)
    # value added to row + dr by this row: sum over the span of 1 - (dr^2 + (c - c0)^2) / h^2
    c0, inv = F.col("col"), 1 / (h * h)
    adds = []
    for dr, w in spans:
        s0, s1, s2 = (F.col(f"_{k}_{w}") for k in range(3))
        adds.append(F.struct(F.lit(dr).alias("d"), ((1 - dr * dr * inv) * s0 - inv * (s2 - 2 * c0 * s1 + c0 * c0 * s0)).alias("v")))
    moved = sums.select("row", "col", F.explode(F.array(*adds)).alias("_a")).where("_a.v <> 0")
    out = moved.groupBy((F.col("row") + F.col("_a.d")).alias("row"), "col").agg((F.sum("_a.v") / F.lit(total)).alias("z"))
    return cells.select("row", "col").join(out, ["row", "col"], "left").withColumn("z", F.greatest(F.lit(0.0), F.coalesce("z", F.lit(0.0))))


def normalise(density: DataFrame) -> DataFrame:
    """z mapped onto [0, 1] by its extremes; a flat surface stays as it is."""
    ends = F.broadcast(density.agg(F.min("z").alias("_lo"), F.max("z").alias("_hi")))  # one row
    z = F.when(F.col("_hi") > F.col("_lo"), (F.col("z") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col("z"))
    return density.crossJoin(ends).withColumn("z", z).drop("_lo", "_hi")


def kde_from_mask(spark: SparkSession, mask: DataFrame, nrows: int, ncols: int, kernel: str = "gaussian", bandwidth: str | float = "auto", cutoff: float | None = None) -> DataFrame:
    """Dense density surface in [0, 1]. ``bandwidth``: ``auto`` (Scott, isotropic; on cell numbers for
    the Epanechnikov kernel), ``auto_indices`` (Scott on cell numbers) or a number of cells; with
    ``cutoff`` smaller values become 0."""
    from .raster import grid_cells

    cells = grid_cells(spark, nrows, ncols).select("row", "col")
    if isinstance(bandwidth, str):
        h = scott_sigma(mask)[0] if bandwidth == "auto" and kernel == "gaussian" else scott_sigma_indices(mask)
    else:
        h = float(bandwidth)
    if kernel == "gaussian":
        out = cells.join(gaussian_density(mask, nrows, ncols, h), ["row", "col"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)))
    elif kernel == "epanechnikov":
        out = epanechnikov_density(mask, cells, h)
    else:
        raise ValueError(f"unknown kernel: {kernel}")
    out = normalise(out)
    return out if cutoff is None else out.withColumn("z", F.when(F.col("z") >= cutoff, F.col("z")).otherwise(F.lit(0.0)))


def validate_range(surface: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Raises when a value lies outside [0, 1]."""
    r = surface.agg(F.min("z").alias("lo"), F.max("z").alias("hi")).first()
    if r.lo is not None and (r.lo < -tol or r.hi > 1 + tol):
        raise ValueError(f"density outside [0, 1]: {r.lo} to {r.hi}")
    return surface
