"""Connected components, holes, opening and closing of cell masks (rows row, col)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components as connected
from .raster import grid_cells
from .stats import QUEEN, ROOK


def _shifted(mask: DataFrame, shifts: Sequence[tuple[int, int]], *more: str) -> DataFrame:
    s = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in shifts]))
    return mask.withColumn("_s", s).select((F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"), *more)


def components(mask: DataFrame, width: int, neighbours: Sequence[tuple[int, int]] = QUEEN) -> DataFrame:
    """(row, col, component): the smallest cell number of each connected component."""
    cell = (F.col("row").cast("long") * width + F.col("col")).alias("cell")
    cells = mask.select("row", "col", cell).distinct()
    edges = _shifted(cells, neighbours, F.col("cell").alias("a")).join(cells.withColumnRenamed("cell", "b"), ["row", "col"]).select("a", "b").where("a < b")
    found = connected(edges).withColumnRenamed("node", "cell")
    return cells.join(found, "cell", "left").select("row", "col", F.coalesce("comp", "cell").alias("component"))


def remove_small_components(mask: DataFrame, width: int, min_cells: int, neighbours: Sequence[tuple[int, int]] = QUEEN) -> DataFrame:
    c = components(mask, width, neighbours)
    keep = c.groupBy("component").count().where(F.col("count") >= min_cells).select("component")
    return c.join(keep, "component").select("row", "col")


def fill_small_holes(mask: DataFrame, nrows: int, ncols: int, max_cells: int) -> DataFrame:
    """Adds background components (edge neighbours) of at most ``max_cells`` cells that do not
    touch the border."""
    empty = grid_cells(mask.sparkSession, nrows, ncols).select("row", "col").join(mask, ["row", "col"], "left_anti")
    c = components(empty, ncols, ROOK)
    border = F.max(((F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == nrows - 1) | (F.col("col") == ncols - 1)).cast("int"))
    holes = c.groupBy("component").agg(F.count("*").alias("n"), border.alias("b")).where((F.col("n") <= max_cells) & (F.col("b") == 0)).select("component")
    return mask.select("row", "col").union(c.join(holes, "component").select("row", "col"))


def dilate(mask: DataFrame, nrows: int, ncols: int) -> DataFrame:
    return _shifted(mask, [(0, 0), *QUEEN]).where(F.col("row").between(0, nrows - 1) & F.col("col").between(0, ncols - 1)).distinct()


def erode(mask: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """Cells whose neighbours inside the grid are all set."""
    hits = _shifted(mask, [(0, 0), *QUEEN]).groupBy("row", "col").agg(F.count("*").alias("n"))
    span = lambda c, n: F.when((F.col(c) == 0) | (F.col(c) == n - 1), 2 if n > 1 else 1).otherwise(3)
    return mask.join(hits, ["row", "col"]).where(F.col("n") == span("row", nrows) * span("col", ncols)).select("row", "col")


def open_close(mask: DataFrame, nrows: int, ncols: int) -> DataFrame:
    opened = dilate(erode(mask, nrows, ncols), nrows, ncols)
    return erode(dilate(opened, nrows, ncols), nrows, ncols)
