"""Flown tracks: planned lines, survey-leg segmentation and tracking summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ground_speed, ratio, speed_bounds_of


def derive_planned_lines(waypoints: DataFrame, min_points: int = 10, min_span: float = 250.0, keys: Sequence[str] = ()) -> DataFrame:
    """Lines from waypoints (x, y): groups of equal y rounded half to even, long and full enough,
    numbered by their median y. The lines are few; the numbering window runs over them alone."""
    lines = (
        waypoints.groupBy(*keys, F.rint("y").alias("_y"))
        .agg(F.median("y").alias("y_center"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.count("*").alias("n"))
        .where((F.col("n") >= min_points) & (F.col("x_max") - F.col("x_min") >= min_span))
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("y_center", "_y"))
    return lines.select(*keys, (number - 1).alias("line_index"), number.alias("line_number"), "y_center", "x_min", "x_max", "n")


def assign_to_planned_lines(track: DataFrame, lines: DataFrame) -> DataFrame:
    """The nearest line by |y - y_center|, the lower index on a tie. The lines travel as one array
    (a survey has a handful), so the track is not shuffled."""
    known = lines.agg(F.array_sort(F.collect_list(F.struct("line_index", "y_center", "x_min", "x_max"))).alias("_lines"))
    best = F.array_min(F.transform("_lines", lambda s: F.struct(F.abs(F.col("y") - s["y_center"]).alias("d"), s["line_index"].alias("line_index"), s["y_center"].alias("y_center"), s["x_min"].alias("x_min"), s["x_max"].alias("x_max"))))
    out = track.crossJoin(F.broadcast(known)).withColumn("_best", best).drop("_lines")
    return out.select(
        *track.columns,
        F.col("_best.line_index").alias("nearest_line"),
        F.col("_best.d").alias("cross_track_m"),
        F.col("_best.y_center").alias("_planned"),
        F.col("_best.x_min").alias("_x_min"),
        F.col("_best.x_max").alias("_x_max"),
    )


def contiguous_segments(track: DataFrame, selected: Column, line: str = "nearest_line", key: Sequence[str] = ("mission",), order: Sequence[str] = ("seq",), time: str = "time", max_gap: float = 0.25) -> DataFrame:
    """``segment_id``: a new segment begins after a gap, on a change of line, or after unselected
    rows; -1 for unselected rows."""
    w = Window.partitionBy(*key).orderBy(*order)
    df = track.withColumn("_sel", F.coalesce(selected, F.lit(False)))
    was = F.coalesce(F.lag("_sel").over(w), F.lit(False))
    broken = ~was | (F.lag(line).over(w) != F.col(line)) | (F.col(time) - F.lag(time).over(w) > F.lit(max_gap))
    df = df.withColumn("_new", (F.col("_sel") & F.coalesce(broken, F.lit(True))).cast("int"))
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return df.withColumn("segment_id", F.when(F.col("_sel"), run).otherwise(F.lit(-1)).cast("int")).drop("_sel", "_new")


def fitted_line_centers(track: DataFrame, lines: DataFrame, selected: Column, min_samples: int = 100, key: Sequence[str] = ("mission",)) -> DataFrame:
    """Median y of a line's selected samples where there are enough, else the planned centre."""
    found = track.where(selected).groupBy(*key, "nearest_line").agg(F.count("*").alias("_k"), F.median("y").alias("_med"))
    missions = track.select(*key).distinct()
    plan = missions.crossJoin(F.broadcast(lines.select(F.col("line_index").alias("nearest_line"), "y_center")))
    return plan.join(found, [*key, "nearest_line"], "left").select(
        *key, "nearest_line", F.when(F.col("_k") >= min_samples, F.col("_med")).otherwise(F.col("y_center")).alias("fitted_center")
    )


def clean_survey_segments(
    track: DataFrame,
    lines: DataFrame,
    label: str = "mission",
    bounds: tuple[float, float] | None = None,
    cross_track: float = 12.0,
    x_margin: float = 12.0,
    heading: float = 0.72,
    max_gap: float = 0.25,
    min_duration: float = 2.5,
    min_span: float = 80.0,
    min_samples: int = 150,
    fit_samples: int = 100,
) -> DataFrame:
    """``track(mission, seq, x, y, ve, vn, time)`` with speed, nearest line, fitted centre, errors,
    segment and ``survey_leg_clean``; the clean rows are those where it holds."""
    df = assign_to_planned_lines(track.withColumn("speed", ground_speed(F.col("ve"), F.col("vn"))), lines)
    low, high = (F.lit(b) for b in bounds) if bounds else speed_bounds_of(F.col(label))
    candidate = (
        (F.col("cross_track_m") <= cross_track)
        & F.col("x").between(F.col("_x_min") - x_margin, F.col("_x_max") + x_margin)
        & (F.abs("ve") / F.greatest("speed", F.lit(1e-6)) >= heading)
        & F.col("speed").between(low, high)
    )
    df = df.withColumn("_candidate", candidate)
    centres = fitted_line_centers(df, lines, F.col("_candidate"), fit_samples)
    df = df.join(F.broadcast(centres), ["mission", "nearest_line"])  # missions times lines
    df = df.withColumns({"tracking_error_m": F.abs(F.col("y") - F.col("fitted_center")), "planned_offset_m": F.col("fitted_center") - F.col("_planned")})
    df = contiguous_segments(df, F.col("_candidate"), max_gap=max_gap)
    w = Window.partitionBy("mission", "segment_id")
    long_enough = (
        (F.max("time").over(w) - F.min("time").over(w) >= min_duration)
        & (F.max("x").over(w) - F.min("x").over(w) >= min_span)
        & (F.count("*").over(w) >= min_samples)
    )
    return df.withColumn("survey_leg_clean", (F.col("segment_id") >= 0) & long_enough).drop("_candidate", "_planned", "_x_min", "_x_max")


def tracking_summary(clean: DataFrame, key: Sequence[str] = ("mission",)) -> DataFrame:
    pct = lambda c, p: F.percentile(c, F.lit(p))
    offset = F.abs("planned_offset_m")
    seg = F.countDistinct("segment_id")
    return clean.groupBy(*key).agg(
        F.count("*").alias("samples"),
        seg.alias("segments"),
        (F.max("time") - F.min("time")).alias("duration_s"),
        F.avg("speed").alias("mean_speed"),
        F.median("speed").alias("median_speed"),
        pct("speed", 0.1).alias("p10_speed"),
        pct("speed", 0.9).alias("p90_speed"),
        F.median(offset).alias("median_offset"),
        pct(offset, 0.95).alias("p95_offset"),
        pct("cross_track_m", 0.95).alias("p95_cross_track"),
        F.avg("tracking_error_m").alias("mean_error"),
        F.median("tracking_error_m").alias("median_error"),
        pct("tracking_error_m", 0.95).alias("p95_error"),
        F.sqrt(F.avg(F.col("tracking_error_m") * F.col("tracking_error_m"))).alias("rms_error"),
    )


def tracking_line_summary(clean: DataFrame) -> DataFrame:
    q = F.percentile("tracking_error_m", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.95)))
    out = clean.groupBy("mission", "nearest_line").agg(F.count("*").alias("samples"), q.alias("_q"), F.sqrt(F.avg(F.col("tracking_error_m") * F.col("tracking_error_m"))).alias("rms_error"))
    return out.select("mission", "nearest_line", "samples", F.col("_q")[1].alias("median_error"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr_error"), F.col("_q")[3].alias("p95_error"), "rms_error")


def tracking_segment_summary(clean: DataFrame) -> DataFrame:
    """A segment breaks on a change of line, so its line is that of any row."""
    return clean.groupBy("mission", "segment_id").agg(
        F.first("nearest_line").alias("line"),
        F.count("*").alias("samples"),
        (F.max("time") - F.min("time")).alias("duration_s"),
        (F.max("x") - F.min("x")).alias("x_span"),
        F.avg("speed").alias("mean_speed"),
        F.median("tracking_error_m").alias("median_error"),
        F.percentile("tracking_error_m", F.lit(0.95)).alias("p95_error"),
    )


def mission_time_metrics(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Raw duration, summed segment durations, survey wall span and their fractions; null without
    a survey leg."""
    whole = raw.groupBy("mission").agg((F.max("time") - F.min("time")).alias("raw_duration_s"))
    legs = clean.groupBy("mission", "segment_id").agg(F.min("time").alias("_a"), F.max("time").alias("_b"))
    legs = legs.groupBy("mission").agg(F.sum(F.col("_b") - F.col("_a")).alias("survey_duration_s"), (F.max("_b") - F.min("_a")).alias("survey_wall_s"), F.count("*").alias("segments"))
    out = whole.join(legs, "mission", "left")
    return out.select(
        "mission",
        "raw_duration_s",
        "survey_duration_s",
        "survey_wall_s",
        F.coalesce("segments", F.lit(0)).alias("segments"),
        ratio(F.col("survey_duration_s"), F.col("raw_duration_s")).alias("survey_fraction"),
        ratio(F.col("survey_duration_s"), F.col("survey_wall_s")).alias("on_line_fraction"),
    )


def flight_line_profile(waypoints: DataFrame, key: Sequence[str] = ("mission",), order: str = "seq") -> DataFrame:
    """Distance along the track: the running sum of steps between neighbours."""
    w = Window.partitionBy(*key).orderBy(order)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    df = waypoints.withColumn("step", step)
    return df.withColumn("distance", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def waypoint_spacing(waypoints: DataFrame, key: Sequence[str] = ("mission",), order: str = "seq") -> DataFrame:
    """Spacing statistics without transit jumps (over three times the median; all, if none is left)."""
    w = Window.partitionBy(*key).orderBy(order)
    steps = waypoints.withColumn("d", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))).where("d is not null")
    limit = steps.groupBy(*key).agg((3 * F.median("d")).alias("_m"))
    kept = F.when(F.col("d") <= F.col("_m"), F.col("d"))
    q = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    out = steps.join(F.broadcast(limit), list(key)).groupBy(*key).agg(F.percentile(kept, q).alias("_k"), F.percentile("d", q).alias("_a"), F.avg(kept).alias("_mk"), F.avg("d").alias("_ma"), F.count(kept).alias("n"))
    some = F.col("n") > 0
    pick = F.when(some, F.col("_k")).otherwise(F.col("_a"))
    return out.select(*key, "n", pick[1].alias("median"), F.when(some, F.col("_mk")).otherwise(F.col("_ma")).alias("mean"), pick[0].alias("p5"), pick[2].alias("p95"))


def smooth_speeds(waypoints: DataFrame, window: int, key: Sequence[str] = ("mission",), order: str = "seq") -> DataFrame:
    """Centred moving average of an odd window, cut off at the ends."""
    if window < 1 or window % 2 == 0:
        raise ValueError("the window must be odd and positive")
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-(window // 2), window // 2)
    return waypoints.withColumn("speed", F.avg("speed").over(w))
