"""Dense grids: synthesis, interpolation, derivatives, resampling and moving windows.

A grid is rows (row, col, x, y, z), row 0 in the north.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import clamp, nearest_index


def grid_cells(spark: SparkSession, nrows: int, ncols: int, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """All cells of a grid; x and y are ``x0 + col * dx`` and ``y0 + row * dy``."""
    col = F.explode(F.sequence(F.lit(0), F.lit(ncols - 1))).alias("col")
    cells = spark.range(nrows).select(F.col("id").cast("int").alias("row"), col)
    return cells.withColumns({"x": F.lit(x0) + F.col("col") * F.lit(dx), "y": F.lit(y0) + F.col("row") * F.lit(dy)})


def gaussian_grid(cells: DataFrame, centres: Sequence[tuple[float, float]], sigmas: Sequence[float], weights: Sequence[float]) -> DataFrame:
    """A mixture of Gaussians, scaled to [0, 1]."""
    z = F.lit(0.0)
    for (cx, cy), s, w in zip(centres, sigmas, weights, strict=True):
        z = z + F.lit(w) * F.exp(-((F.col("x") - cx) ** 2 + (F.col("y") - cy) ** 2) / F.lit(2 * s * s))
    from .coverage import rescale_density

    return rescale_density(cells.withColumn("z", z))


def uniform_grid(cells: DataFrame, value: float) -> DataFrame:
    return cells.withColumn("z", F.lit(float(value)))


def mask_grid(cells: DataFrame, frac: float, nrows: int, ncols: int) -> DataFrame:
    """An ellipse in the middle; its half axes are sqrt(frac) of the extents' halves."""
    a, b = frac**0.5 * ncols / 2, frac**0.5 * nrows / 2
    u, v = (F.col("col") - F.lit((ncols - 1) / 2)) / F.lit(a), (F.col("row") - F.lit((nrows - 1) / 2)) / F.lit(b)
    return cells.withColumn("z", (u * u + v * v <= 1).cast("double"))


class Axes:
    """Origin, step and size of a regular grid's axes; steps may be negative."""

    def __init__(self, x0: float, dx: float, ncols: int, y0: float, dy: float, nrows: int):
        self.x0, self.dx, self.ncols, self.y0, self.dy, self.nrows = x0, dx, ncols, y0, dy, nrows


def _corner(grid: DataFrame, n: int) -> DataFrame:
    return grid.select(F.col("row").alias(f"_r{n}"), F.col("col").alias(f"_c{n}"), F.col("z").alias(f"_z{n}"))


def sample(points: DataFrame, grid: DataFrame, axes: Axes, method: str = "bilinear", out: str = "z") -> DataFrame:
    """The grid's value at points (x, y), clamped to the extent. Corners are found by equi-joins on
    computed cell numbers."""
    if method == "nearest":
        i, j = nearest_index(F.col("x"), axes.x0, axes.dx, axes.ncols), nearest_index(F.col("y"), axes.y0, axes.dy, axes.nrows)
        hit = points.withColumns({"_r0": j, "_c0": i}).join(_corner(grid, 0), ["_r0", "_c0"], "left")
        return hit.withColumn(out, F.col("_z0")).drop("_r0", "_c0", "_z0")
    u = clamp((F.col("x") - axes.x0) / axes.dx, 0.0, axes.ncols - 1.0)
    v = clamp((F.col("y") - axes.y0) / axes.dy, 0.0, axes.nrows - 1.0)
    df = points.withColumns({"_u": u, "_v": v})
    c0, r0 = F.least(F.floor("_u"), F.lit(max(axes.ncols - 2, 0))).cast("int"), F.least(F.floor("_v"), F.lit(max(axes.nrows - 2, 0))).cast("int")
    df = df.withColumns({"_c0": c0, "_r0": r0})
    for n, (dr, dc) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        if n:
            df = df.withColumns({f"_r{n}": F.least(F.col("_r0") + dr, F.lit(axes.nrows - 1)), f"_c{n}": F.least(F.col("_c0") + dc, F.lit(axes.ncols - 1))})
        df = df.join(_corner(grid, n), [f"_r{n}", f"_c{n}"], "left")
    fx, fy = F.col("_u") - F.col("_c0"), F.col("_v") - F.col("_r0")
    z = (1 - fy) * ((1 - fx) * F.col("_z0") + fx * F.col("_z1")) + fy * ((1 - fx) * F.col("_z2") + fx * F.col("_z3"))
    return df.withColumn(out, z).select(*points.columns, out) if out not in points.columns else df.withColumn(out, z).select(*points.columns)


def probe(points: DataFrame, grid: DataFrame, axes: Axes, offsets: dict[str, tuple[float, float]]) -> DataFrame:
    """Bilinear samples at shifted places, one column each."""
    df = points
    for name, (ox, oy) in offsets.items():
        moved = df.withColumns({"_x": F.col("x"), "_y": F.col("y"), "x": F.col("x") + ox, "y": F.col("y") + oy})
        df = sample(moved, grid, axes, out=name).withColumns({"x": F.col("_x"), "y": F.col("_y")}).drop("_x", "_y")
    return df


def gradient(points: DataFrame, grid: DataFrame, axes: Axes) -> DataFrame:
    """gx, gy by central differences over half a cell, and the gradient's magnitude."""
    hx, hy = abs(axes.dx) / 2, abs(axes.dy) / 2
    df = probe(points, grid, axes, {"_e": (hx, 0), "_w": (-hx, 0), "_n": (0, hy), "_s": (0, -hy)})
    df = df.withColumns({"gx": (F.col("_e") - F.col("_w")) / (2 * hx), "gy": (F.col("_n") - F.col("_s")) / (2 * hy)}).drop("_e", "_w", "_n", "_s")
    return df.withColumn("gradient", F.hypot("gx", "gy"))


def directional_curvature(points: DataFrame, grid: DataFrame, axes: Axes, ux: float, uy: float) -> DataFrame:
    """Second difference along the unit direction (ux, uy)."""
    h = min(abs(axes.dx), abs(axes.dy)) / 2
    df = probe(points, grid, axes, {"_p": (h * ux, h * uy), "_0": (0, 0), "_m": (-h * ux, -h * uy)})
    return df.withColumn("curvature", (F.col("_p") - 2 * F.col("_0") + F.col("_m")) / (h * h)).drop("_p", "_0", "_m")


def line_points(segments: DataFrame, n: int) -> DataFrame:
    """n >= 2 evenly spaced points on each segment (xa, ya, xb, yb)."""
    if n < 2:
        raise ValueError("a line needs two points at least")
    t = F.col("k") / F.lit(n - 1)
    df = segments.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return df.withColumns({"x": F.col("xa") + t * (F.col("xb") - F.col("xa")), "y": F.col("ya") + t * (F.col("yb") - F.col("ya"))})


def resample_world(grid: DataFrame, source: Axes, target: DataFrame, method: str = "nearest") -> DataFrame:
    """The grid's value at the target cells' world coordinates; nearest is half to even."""
    if method == "bilinear":
        return sample(target, grid, source)
    c = F.greatest(F.lit(0), F.least(F.lit(source.ncols - 1), F.rint((F.col("x") - source.x0) / source.dx))).cast("int")
    r = F.greatest(F.lit(0), F.least(F.lit(source.nrows - 1), F.rint((F.col("y") - source.y0) / source.dy))).cast("int")
    return _pick(target, grid, r, c)


def resample_image(grid: DataFrame, nrows: int, ncols: int, target: DataFrame, trows: int, tcols: int) -> DataFrame:
    """Nearest value by proportion of rows and columns, whatever the coordinates."""
    r = F.greatest(F.lit(0), F.least(F.lit(nrows - 1), F.rint((F.col("row") + 0.5) * F.lit(nrows / trows) - 0.5))).cast("int")
    c = F.greatest(F.lit(0), F.least(F.lit(ncols - 1), F.rint((F.col("col") + 0.5) * F.lit(ncols / tcols) - 0.5))).cast("int")
    return _pick(target, grid, r, c)


def _pick(target: DataFrame, grid: DataFrame, r: Column, c: Column) -> DataFrame:
    keep = [k for k in target.columns if k != "z"]
    return target.withColumns({"_r0": r, "_c0": c}).join(_corner(grid, 0), ["_r0", "_c0"], "left").select(*keep, F.col("_z0").alias("z"))


def decimate(grid: DataFrame, stride: int) -> DataFrame:
    return grid.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0))


def preview_stride(nrows: int, ncols: int, cap: int = 2000) -> int:
    return max(1, -(-max(nrows, ncols) // cap))


def upsample_labels(labels: DataFrame, cells: DataFrame, stride: int, nrows: int, ncols: int) -> DataFrame:
    """Labels of the decimated grid for all cells of the full one."""
    last_r, last_c = (nrows - 1) // stride * stride, (ncols - 1) // stride * stride
    r = F.least(F.floor(F.col("row") / stride) * stride, F.lit(last_r)).cast("int")
    c = F.least(F.floor(F.col("col") / stride) * stride, F.lit(last_c)).cast("int")
    small = labels.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "label")
    return cells.withColumns({"_r": r, "_c": c}).join(small, ["_r", "_c"]).drop("_r", "_c")


def local_variance(grid: DataFrame, radius: int, key: Sequence[str] = ()) -> DataFrame:
    """Population variance in a square window, cut off at the borders: two one-dimensional passes
    over sums, so the cost does not grow with the window."""
    row = Window.partitionBy(*key, "row").orderBy("col").rangeBetween(-radius, radius)
    col = Window.partitionBy(*key, "col").orderBy("row").rangeBetween(-radius, radius)
    df = grid.withColumns({"_s": F.sum("z").over(row), "_q": F.sum(F.col("z") * F.col("z")).over(row), "_n": F.count("z").over(row)})
    df = df.withColumns({f"_t{c}": F.sum(f"_{c}").over(col) for c in ("s", "q", "n")})
    mean = F.col("_ts") / F.col("_tn")
    return df.withColumn("local_var", F.greatest(F.lit(0.0), F.col("_tq") / F.col("_tn") - mean * mean)).drop("_s", "_q", "_n", "_ts", "_tq", "_tn")


def gradient_magnitude(grid: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Half the difference of the neighbours, which at a border is the cell itself."""
    row, col = Window.partitionBy(*key, "row").orderBy("col"), Window.partitionBy(*key, "col").orderBy("row")
    diff = lambda w: (F.coalesce(F.lead("z").over(w), F.col("z")) - F.coalesce(F.lag("z").over(w), F.col("z"))) / 2
    return grid.withColumns({"_gx": diff(row), "_gy": diff(col)}).withColumn("grad_mag", F.hypot("_gx", "_gy")).drop("_gx", "_gy")
