"""End-to-end compositions: image to mission, counts to statistics, track to coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import bootstrap, coverage, features, kde, linescan, planner, raster, stats, trajectory
from ..sources.georef import GeoTransform


def mask_from_pixels(pixels: DataFrame, k: int | None = None, tree_labels: Sequence[int] = (1,), nsample: int = 2000, seed: int = 6213, strategy: str = "vote", ks: Sequence[int] = range(2, 13), pca: bool = False, metric: str = "sqeuclidean", width: int | None = None) -> DataFrame:
    """(row, col, label, mask) of pixels (row, col, r, g, b): CIELAB features are standardised,
    clustered on a bounded sample, and every pixel takes its nearest medoid. Without ``k`` the
    number of clusters is chosen by the quality indices."""
    if not tree_labels:
        raise ValueError("name the tree labels")
    width = width or (pixels.agg(F.max("col")).first()[0] or 0) + 1
    f = features.pixel_features(pixels)
    p = features.fit_projector(f, 3, pca)
    f = f.select("row", "col", (F.col("row").cast("long") * width + F.col("col")).alias("id"), p.column().alias("f"))
    if k is None:
        k = features.choose_k(features.sweep_k(f, ks, nsample, seed), strategy)
    labels, _ = features.kmedoids(f, k, nsample, seed, metric)
    return features.labels_to_mask(labels, tree_labels).select("row", "col", "label", "mask")


def mask_from_pixels_strided(pixels: DataFrame, stride: int, nrows: int, ncols: int, **how) -> DataFrame:
    """The same on every stride-th row and column, labels spread to the full grid."""
    small = raster.decimate(pixels, stride)
    mask = mask_from_pixels(small, width=ncols, **how)
    trees = list(how.get("tree_labels", (1,)))
    full = raster.upsample_labels(mask, pixels.select("row", "col"), stride, nrows, ncols)
    return features.labels_to_mask(full, trees).select("row", "col", "label", "mask")


def plan_from_pixels(pixels: DataFrame, nrows: int, ncols: int, axes: raster.Axes, flight: planner.Strategy, spec: planner.SweepSpec | None = None, kernel: str = "gaussian", bandwidth: str | float = "auto", cutoff: float | None = None, stride: int = 1, mission: dict | None = None, **mask) -> dict[str, DataFrame]:
    """Mask, density surface and waypoints; every argument reaches its stage."""
    m = mask_from_pixels_strided(pixels, stride, nrows, ncols, **mask) if stride > 1 else mask_from_pixels(pixels, width=ncols, **mask)
    surface = kde.kde_from_mask(pixels.sparkSession, m.where("mask").select("row", "col"), nrows, ncols, kernel, bandwidth, cutoff)
    return {"mask": m, "surface": surface, "waypoints": planner.plan_mission(surface, axes, flight, spec, **(mission or {}))}


def summarize_counts(counts: DataFrame, cover_n: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """One row of statistics per (ret, cover, mission, kernel), labelled and sorted; N and CR use
    the sizes ``cover_n(cover, N)``, structure the union mask of all records."""
    keys = ["ret", "cover", "mission", "kernel"]
    if masks is None:
        masks = coverage.build_cover_masks(counts)
    inside = counts.join(masks, ["cover", "row", "col"], "left_semi")
    out = stats.summary_statistics(inside, cover_n, keys)
    labels = {"Return": X.return_label(F.col("ret")), "Cover": X.cover_label(F.col("cover")), "Mission": X.mission_label(F.col("mission")), "Kernel": X.kernel_label(F.col("kernel"))}
    rest = [c for c in out.columns if c not in keys]  # names differ from the keys' only in case
    return out.select(*[c.alias(n) for n, c in labels.items()], *rest).orderBy(*labels)


def lidar_counts(points: DataFrame, classes: DataFrame, gt: GeoTransform, nrows: int, ncols: int) -> dict[str, DataFrame]:
    """Count grids of all and ground returns over a class raster, with both summary tables."""
    counts = coverage.bin_points(points, classes, gt.x0, gt.y0, gt.dx, -gt.dy, nrows, ncols)
    sizes = classes.groupBy("cover").agg(F.count("*").alias("N"))
    keys = ["ret", "cover", "mission", "kernel"]
    return {
        "counts": counts,
        "densities": coverage.percent_density_table(counts, sizes.withColumnRenamed("N", "ncover"), keys),
        "statistics": stats.cover_stats_table(counts, sizes, keys),
    }


def trajectory_analysis(track: DataFrame, waypoints: DataFrame, counts: DataFrame, *, xmin: float, ymin: float, cell: float, nrows: int, guided: str, against: Sequence[str], **cleaning) -> dict[str, DataFrame]:
    """Lines, cleaned legs, tracking summaries, extents, common overlap and line-scan coverage."""
    lines = trajectory.derive_planned_lines(waypoints)
    full = trajectory.clean_survey_segments(track, lines, **cleaning)
    clean = full.where("survey_leg_clean")
    extents = linescan.actual_line_extents(clean)
    missions = [guided, *against]
    overlap = linescan.common_x_overlap(extents, len(missions))
    table = track.sparkSession.createDataFrame([(m,) for m in missions], "mission string")
    scan = linescan.line_scan_cover_metrics(counts, lines, overlap, table, ymin=ymin, xmin=xmin, cell=cell, nrows=nrows)
    wide = linescan.wide_differences(scan["scan"], missions, guided, against)
    return {
        "lines": lines,
        "legs": full,
        "tracking": trajectory.tracking_summary(clean),
        "tracking_lines": trajectory.tracking_line_summary(clean),
        "tracking_segments": trajectory.tracking_segment_summary(clean),
        "time": trajectory.mission_time_metrics(track, clean),
        "extents": extents,
        "overlap": overlap,
        **{f"scan_{k}": v for k, v in scan.items()},
        "wide": wide,
        "best": linescan.best_lines(wide, f"{guided}_minus_{against[0]}"),
    }


def inference(counts: DataFrame, nrows: int, ncols: int, comparisons: DataFrame, cover_n: DataFrame | None = None, **how) -> dict[str, DataFrame]:
    """Bootstrap intervals of every record and of the compared pairs."""
    masks = coverage.build_cover_masks(counts)
    keys = [c for c in ("ret", "cover", "mission", "kernel") if c in counts.columns]
    return {
        "intervals": bootstrap.bootstrap_cr_table(counts, masks, keys, nrows, ncols, cover_n, **how),
        "differences": bootstrap.bootstrap_cr_difference_table(counts, masks, comparisons, nrows, ncols, **how),
    }
