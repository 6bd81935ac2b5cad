from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from swathe.functions import expressions as X
from swathe.operators import linescan
from swathe.operators import trajectory as T


def test_planned_lines(spark):
    pts = [(50 + 300 * i / 11, y) for y in (200.3, 100.2) for i in range(12)] + [(0.0, 150.0), (0.0, 151.0)]
    got = T.derive_planned_lines(spark.createDataFrame(pts, "x double, y double")).orderBy("line_index").collect()
    assert [(r.line_index, r.line_number, r.y_center, r.x_min, r.x_max, r.n) for r in got] == [(0, 1, 100.2, 50, 350, 12), (1, 2, 200.3, 50, 350, 12)]


def test_nearest_line_takes_the_first_on_a_tie(spark):
    lines = spark.createDataFrame([(i, y, 0.0, 1.0) for i, y in enumerate((100.0, 200.0, 300.0))], "line_index int, y_center double, x_min double, x_max double")
    track = spark.createDataFrame([(i, y) for i, y in enumerate((99.0, 201.0, 300.5, 145.0, 150.0))], "seq int, y double")
    got = T.assign_to_planned_lines(track, lines).orderBy("seq").collect()
    assert [r.nearest_line for r in got] == [0, 1, 2, 0, 0] and [r.cross_track_m for r in got][:3] == [1, 1, 0.5]


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(0.0, 0, True), (0.1, 0, True), (0.2, 0, True), (0.3, 0, True)], [0, 0, 0, 0]),
        ([(0.0, 0, True), (0.1, 0, True), (0.2, 1, True), (0.3, 1, True)], [0, 0, 1, 1]),
        ([(0.0, 0, True), (0.4, 0, True), (0.5, 0, True)], [0, 1, 1]),
        ([(0.0, 0, True), (0.1, 0, False), (0.2, 0, True)], [0, -1, 1]),
    ],
)
def test_segments(spark, rows, expected):
    df = spark.createDataFrame([("m", i, t, line, ok) for i, (t, line, ok) in enumerate(rows)], "mission string, seq int, time double, nearest_line int, ok boolean")
    assert [r.segment_id for r in T.contiguous_segments(df, F.col("ok")).orderBy("seq").collect()] == expected


def test_bounds_and_speed(spark):
    df = spark.createDataFrame([("Const. 2 m/s",), ("Const. 8 m/s",), ("KDE-guided (Epanechnikov)",)], "m string")
    lo, hi = X.speed_bounds_of(F.col("m"))
    assert [(r.a, r.b) for r in df.select(lo.alias("a"), hi.alias("b")).collect()] == [(1, 3.2), (6, 10.5), (1, 9.5)]
    assert df.select(X.ground_speed(F.lit(3.0), F.lit(4.0)).alias("v")).first().v == 5


def survey(spark):
    rows = [("m", i, i * 100 / 499, 100.5, 2.0, 0.0, i * 0.1) for i in range(500)] + [("m", 500 + i, 100.0, 120.0 + i, 0.0, 2.0, 50 + i * 0.1) for i in range(10)]
    track = spark.createDataFrame(rows, "mission string, seq int, x double, y double, ve double, vn double, time double")
    lines = spark.createDataFrame([(0, 1, 100.0, 0.0, 100.0, 12), (1, 2, 200.0, 0.0, 100.0, 12)], "line_index int, line_number int, y_center double, x_min double, x_max double, n long")
    return track, T.clean_survey_segments(track, lines)


def test_cleaning_and_summaries(spark):
    track, full = survey(spark)
    assert full.count() == 510
    clean = full.where("survey_leg_clean")
    r = T.tracking_summary(clean).first()
    assert r.samples == 500 and r.segments == 1 and r.mean_speed == 2 and r.median_error < 2
    assert [x.line for x in T.tracking_segment_summary(clean).collect()] == [0]
    assert T.tracking_line_summary(clean).first().nearest_line == 0
    t = T.mission_time_metrics(track, clean).first()
    assert t.segments == 1 and 0 < t.survey_fraction < 1 and t.on_line_fraction == 1
    none = T.mission_time_metrics(track, clean.where("false")).first()
    assert none.segments == 0 and none.survey_duration_s is None
    e = linescan.actual_line_extents(clean).first()
    assert e.samples == 500 and e.x_min_raw == 0 and e.x_max_raw == 100


def test_overlap(spark):
    e = spark.createDataFrame([("A", 0, 10.0, 180.0), ("B", 0, 20.0, 190.0), ("A", 1, 30.0, 200.0), ("B", 1, 0.0, 210.0), ("A", 2, 0.0, 1.0)], "mission string, line_index int, x_min_actual double, x_max_actual double")
    got = {r.line_index: (r.x0, r.x1) for r in linescan.common_x_overlap(e, 2).collect()}
    assert got == {0: (20, 180), 1: (30, 200)}


def test_gaps_and_profiles(spark, matrix):
    p = spark.createDataFrame([("k", x) for x in (0.0, 5.0, 10.0, 50.0, 55.0)], "k string, x_center double")
    assert [r.piece for r in linescan.split_at_gaps(p, ["k"], 20).orderBy("x_center").collect()] == [0, 0, 0, 1, 1]
    grid = matrix([[1] * 50] * 10, k="x").withColumn("x", F.col("col").cast("double"))
    out = linescan.along_track_cr(grid, ["k"], 0.0, 50.0)
    assert [r.cr for r in out.collect()] == [1.0] * 10 and {r.ncells for r in out.collect()} == {50}
    assert linescan.along_track_weakness(out, ["k"]).first().weak


def test_line_scan(spark):
    counts = spark.createDataFrame([(ret, "field", m, r, c, 1) for ret in ("all", "ground") for m in ("a", "b") for r in range(6) for c in range(10) if ret == "all" or (m == "a" and r < 3)], "ret string, cover string, mission string, row int, col int, n int")
    lines = spark.createDataFrame([(0, 1, 3.0, 0.0, 10.0, 12)], "line_index int, line_number int, y_center double, x_min double, x_max double, n long")
    overlap = spark.createDataFrame([(0, 0.0, 10.0)], "line_index int, x0 double, x1 double")
    missions = counts.select("mission").distinct()
    got = linescan.line_scan_cover_metrics(counts, lines, overlap, missions, ymin=0.0, xmin=0.0, cell=1.0, nrows=6, half_band_rows=1)
    cr = {r.mission: (r.support, r.covered) for r in got["scan"].collect()}
    assert cr == {"a": (30, 20), "b": (30, 0)}
    wide = linescan.wide_differences(got["scan"], ["a", "b"], "a", ["b"])
    assert wide.first().a_minus_b == pytest.approx(2 / 3)
    assert linescan.best_lines(wide, "a_minus_b", ("field",)).first().line_number == 1
    assert got["profile"].count() == 20


def test_waypoint_helpers(spark):
    w = spark.createDataFrame([("m", i, float(x), 0.0, float(i)) for i, x in enumerate((0, 10, 20, 30, 530, 540))], "mission string, seq int, x double, y double, speed double")
    assert T.flight_line_profile(w).agg(F.max("distance").alias("d")).first().d == 540
    s = T.waypoint_spacing(w).first()
    assert s.n == 4 and s["mean"] == 10
    assert [r.speed for r in T.smooth_speeds(w, 3).orderBy("seq").collect()] == [0.5, 1, 2, 3, 4, 4.5]
    with pytest.raises(ValueError):
        T.smooth_speeds(w, 2)
