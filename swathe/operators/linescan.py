"""Coverage along flown lines: extents, common overlap, band metrics and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ratio


def actual_line_extents(clean: DataFrame) -> DataFrame:
    """Flown x range of each (mission, line): raw and 0.5/99.5 percentiles."""
    q = F.percentile("x", F.array(F.lit(0.005), F.lit(0.995)))
    out = clean.groupBy("mission", F.col("nearest_line").alias("line_index")).agg(
        q.alias("_q"), F.min("x").alias("x_min_raw"), F.max("x").alias("x_max_raw"), F.median("y").alias("y_median"), F.count("*").alias("samples"), F.countDistinct("segment_id").alias("segments")
    )
    return out.select("mission", "line_index", F.col("_q")[0].alias("x_min_actual"), F.col("_q")[1].alias("x_max_actual"), "x_min_raw", "x_max_raw", "y_median", "samples", "segments")


def common_x_overlap(extents: DataFrame, n_missions: int) -> DataFrame:
    """The x range that all missions have flown on a line."""
    return (
        extents.groupBy("line_index")
        .agg(F.max("x_min_actual").alias("x0"), F.min("x_max_actual").alias("x1"), F.countDistinct("mission").alias("_n"))
        .where((F.col("_n") == n_missions) & (F.col("x1") > F.col("x0")))
        .drop("_n")
    )


def bands(lines: DataFrame, overlap: DataFrame, ymin: float, cell: float, nrows: int, half_band_rows: int = 20) -> DataFrame:
    """Row range of each line in grid rows counted from the north."""
    centre = F.floor((F.col("y_center") - F.lit(ymin)) / F.lit(cell)).cast("int")
    south_lo, south_hi = F.greatest(F.lit(0), centre - half_band_rows), F.least(F.lit(nrows - 1), centre + half_band_rows)
    out = lines.join(overlap, "line_index").select("line_index", "line_number", "x0", "x1", south_lo.alias("_a"), south_hi.alias("_b"))
    return out.select("line_index", "line_number", "x0", "x1", (nrows - 1 - F.col("_b")).alias("r0"), (nrows - 1 - F.col("_a")).alias("r1"))


def _covered(counts: DataFrame, masks: DataFrame, bands_: DataFrame, missions: DataFrame, xmin: float, cell: float) -> DataFrame:
    """One row per (line, cover cell in the band, mission) with ``hit``. The lines are a handful,
    so the range condition is evaluated against a broadcast table."""
    x = F.lit(xmin) + (F.col("col") + 0.5) * F.lit(cell)
    support = masks.withColumn("x", x).join(F.broadcast(bands_), F.col("row").between(F.col("r0"), F.col("r1")) & F.col("x").between(F.col("x0"), F.col("x1")))
    hit = counts.where("ret = 'ground' and n > 0").select("mission", "cover", "row", "col", F.lit(1).alias("hit"))
    return support.crossJoin(F.broadcast(missions)).join(hit, ["mission", "cover", "row", "col"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def line_scan_cover_metrics(counts: DataFrame, lines: DataFrame, overlap: DataFrame, missions: DataFrame, *, ymin: float, xmin: float, cell: float, nrows: int, half_band_rows: int = 20, masks: DataFrame | None = None, line_number: int | None = None) -> dict[str, DataFrame]:
    """``scan`` (per line, cover, mission), ``cover`` (pooled over lines), ``profile`` (per column).
    The support is the union of cells with any return, or a fixed mask."""
    if masks is None:
        masks = counts.where("ret = 'all' and n > 0").select("cover", "row", "col").distinct()
    b = bands(lines, overlap, ymin, cell, nrows, half_band_rows)
    if line_number is not None:
        b = b.where(F.col("line_number") == line_number)
    cells = _covered(counts, masks, b, missions, xmin, cell)
    stats = (F.count("*").alias("support"), F.sum("hit").alias("covered"), ratio(F.sum("hit"), F.count("*")).alias("cr"))
    return {
        "scan": cells.groupBy("line_index", "line_number", "cover", "mission").agg(*stats),
        "cover": cells.groupBy("cover", "mission").agg(*stats),
        "profile": cells.groupBy("line_index", "line_number", "cover", "mission", "col").agg(F.first("x").alias("x"), *stats),
    }


def wide_differences(scan: DataFrame, missions: Sequence[str], guided: str, against: Sequence[str]) -> DataFrame:
    """One row per (line, cover): coverage by mission, smallest support, differences to the others."""
    wide = scan.groupBy("line_index", "line_number", "cover").pivot("mission", list(missions)).agg(F.first("cr"))
    least = scan.groupBy("line_index", "line_number", "cover").agg(F.min("support").alias("min_support"))
    wide = wide.join(least, ["line_index", "line_number", "cover"])
    return wide.withColumns({f"{guided}_minus_{m}": F.col(guided) - F.col(m) for m in against})


def best_lines(wide: DataFrame, by: str, covers: Sequence[str] = ("decid", "conif")) -> DataFrame:
    """Per cover the line with the largest difference; the lower line on a tie."""
    return wide.where(F.col("cover").isin(*covers) & F.col(by).isNotNull()).groupBy("cover").agg(F.max_by("line_number", F.struct(F.col(by), -F.col("line_number"))).alias("line_number"), F.max(by).alias(by))


def along_track_cr(cells: DataFrame, keys: Sequence[str], lo: float, hi: float, bin_size: float = 5.0, min_cells: int = 3) -> DataFrame:
    """Coverage ratio of cells (x, n) in bins of x over [lo, hi). Bins are half open, so a cell lies
    in one bin."""
    k = F.floor((F.col("x") - F.lit(lo)) / F.lit(bin_size)).cast("int")
    out = cells.where((F.col("x") >= lo) & (F.col("x") < hi)).groupBy(*keys, k.alias("bin")).agg(F.avg((F.col("n") >= 1).cast("double")).alias("cr"), F.count("*").alias("ncells"))
    return out.where(F.col("ncells") >= min_cells).withColumn("x_center", F.lit(lo) + (F.col("bin") + 0.5) * F.lit(bin_size))


def split_at_gaps(profile: DataFrame, keys: Sequence[str], max_gap: float = 15.0) -> DataFrame:
    """``piece``: numbers the runs of bins without a larger gap between centres."""
    w = Window.partitionBy(*keys).orderBy("x_center")
    gap = (F.coalesce(F.col("x_center") - F.lag("x_center").over(w), F.lit(0.0)) > max_gap).cast("int")
    return profile.withColumn("_g", gap).withColumn("piece", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_g")


def along_track_weakness(profile: DataFrame, keys: Sequence[str], min_valid_bins: int = 10, min_sd: float = 0.01) -> DataFrame:
    """Whether a profile is too short or too flat to say anything."""
    out = profile.groupBy(*keys).agg(F.count("*").alias("bins"), F.stddev_samp("cr").alias("sd"))
    return out.withColumn("weak", (F.col("bins") < min_valid_bins) | (F.coalesce("sd", F.lit(0.0)) < min_sd))


def band_coverage(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage and pooled positive counts of the cells of a band."""
    positive = F.when(F.col("n") > 0, F.col("n"))
    q = F.percentile(positive, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return cells.groupBy(*keys).agg(F.avg((F.col("n") >= 1).cast("double")).alias("cr"), F.count(positive).alias("nonzero"), q.alias("quartiles"))
