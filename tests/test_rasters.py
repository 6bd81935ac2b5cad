from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathe.functions import expressions as X
from swathe.operators import features, kde, morphology, planner, raster, strata


def surface(spark):
    return raster.grid_cells(spark, 3, 4).withColumn("z", (F.col("col") + 2 * F.col("row")).cast("double"))


AXES = raster.Axes(0.0, 1.0, 4, 0.0, 1.0, 3)


def test_bilinear(spark):
    pts = [(0.0, 0.0, 0.0), (3.0, 2.0, 7.0), (0.5, 0.0, 0.5), (0.0, 0.5, 1.0), (0.5, 0.5, 1.5), (-5.0, 0.0, 0.0), (9.0, 9.0, 7.0)]
    df = spark.createDataFrame(pts, "x double, y double, e double")
    assert all(r.z == pytest.approx(r.e) for r in raster.sample(df, surface(spark), AXES).collect())
    assert raster.sample(df.where("x = 0 and y = 0").withColumns({"x": F.lit(1.0), "y": F.lit(1.0)}), surface(spark), AXES, "nearest").first().z == 3
    g = raster.gradient(df.where("x = 0.5 and y = 0.5"), surface(spark), AXES).first()
    assert g.gx == pytest.approx(1) or g.gx == pytest.approx(1.0, abs=1e-9)
    assert abs(raster.directional_curvature(df.where("x = 0.5 and y = 0.5"), surface(spark), AXES, 1.0, 0.0).first().curvature) < 1e-9


def test_resampling(spark):
    cells = surface(spark)
    same = raster.resample_world(cells, AXES, raster.grid_cells(spark, 3, 4))
    assert {(r.row, r.col, r.z) for r in same.collect()} == {(r.row, r.col, r.z) for r in cells.collect()}
    half = raster.resample_image(cells, 3, 4, raster.grid_cells(spark, 3, 2), 3, 2)
    assert half.count() == 6 and half.where("z is null").count() == 0
    assert (raster.preview_stride(9000, 11000, 2000), raster.preview_stride(20000, 20000, 1000), raster.preview_stride(100, 100)) == (6, 20, 1)


def test_moving_windows(spark):
    v = {(r.row, r.col): r.local_var for r in raster.local_variance(surface(spark), 1).collect()}
    assert v[0, 0] == pytest.approx(np.var([0, 1, 2, 3]))
    g = {(r.row, r.col): r.grad_mag for r in raster.gradient_magnitude(surface(spark)).collect()}
    assert g[1, 1] == pytest.approx(math.hypot(1, 2)) and g[0, 0] == pytest.approx(math.hypot(0.5, 1))


def test_upsampling(spark):
    cells = raster.grid_cells(spark, 5, 5).select("row", "col")
    small = raster.decimate(cells, 2).withColumn("label", F.col("row") * 10 + F.col("col"))
    full = {(r.row, r.col): r.label for r in raster.upsample_labels(small, cells, 2, 5, 5).collect()}
    assert len(full) == 25 and full[3, 1] == 20 and full[4, 4] == 44


def test_kernels(spark):
    assert math.fsum(kde.gaussian_weights(1.7)) == pytest.approx(1)
    with pytest.raises(ValueError):
        kde.epanechnikov_offsets(0)
    mask = spark.createDataFrame([(5, 5), (5, 6), (2, 9)], "row int, col int")
    cells = raster.grid_cells(spark, 12, 12)
    got = {(r.row, r.col): r.z for r in kde.epanechnikov_density(mask, cells, 3.0).collect()}
    spans, total = kde.epanechnikov_offsets(3.0)
    expect = np.zeros((12, 12))
    for r, c in ((5, 5), (5, 6), (2, 9)):
        for dr in range(-3, 4):
            for dc in range(-3, 4):
                if dr * dr + dc * dc < 9 and 0 <= r + dr < 12 and 0 <= c + dc < 12:
                    expect[r + dr, c + dc] += (1 - (dr * dr + dc * dc) / 9) / total
    assert max(abs(got[k] - expect[k]) for k in got) < 1e-12
    for kernel in ("gaussian", "epanechnikov"):
        out = kde.kde_from_mask(spark, mask, 12, 12, kernel, cutoff=0.1)
        r = out.agg(F.min("z").alias("a"), F.max("z").alias("b"), F.count("*").alias("n")).first()
        assert (r.a, r.b, r.n) == (0, 1, 144)
    with pytest.raises(ValueError):
        kde.validate_range(spark.createDataFrame([(1.01,)], "z double"))


def test_thresholds_and_strata(spark):
    rng = np.random.default_rng(0)
    z = np.concatenate([np.zeros(300), np.clip(rng.normal(0.35, 0.02, 180), 0, 1), np.clip(rng.normal(0.85, 0.02, 120), 0, 1)])
    df = spark.createDataFrame([(i // 30, i % 30, float(v)) for i, v in enumerate(z)], "row int, col int, z double")
    lower, upper = strata.thresholds(df, strata.MultiOtsu())
    assert 0 < lower <= 0.4 and 0.38 < upper < 0.82
    assert {r.kde_class: r.ncells for r in strata.class_support(strata.assign_classes(df, strata.Manual(0.0, 0.6))).collect()} == {1: 300, 2: 180, 3: 120}
    counts = df.select(F.lit("m").alias("mission"), "row", "col", F.lit(5).alias("n"))
    missions = spark.createDataFrame([("m",), ("empty",)], "mission string")
    s = strata.cr_by_quantile_bins(df, counts, missions)
    assert {r.mission: r.n for r in s.groupBy("mission").agg(F.sum("ncells").alias("n")).collect()} == {"m": 600, "empty": 600}
    assert {r.cr for r in s.where("mission = 'm'").collect()} == {1.0} and {r.cr for r in s.where("mission = 'empty'").collect()} == {0.0}
    w = strata.strata_within_cover(df, counts, missions, df.where("row < 10"))
    assert {round(r.weighted_cr, 9) for r in strata.weighted_cr_check(w).collect()} == {0.0, 1.0}
    one = df.withColumn("z", F.when(F.col("row") == 0, 0.5).otherwise(0.0))
    assert [r.stratum for r in strata.strata_within_cover(one, counts, missions.limit(1), one).orderBy("stratum").collect()] == [0, 1]
    c = strata.class_cr(strata.assign_classes(df, strata.Manual(0.0, 2.0)), counts, missions)
    assert c.count() == 6
    for bad in (lambda: strata.Manual(0.5, 0.1), lambda: strata.Quantile(0.9, 0.1)):
        with pytest.raises(ValueError):
            bad()


def test_manual_classes(spark):
    df = spark.createDataFrame([(z,) for z in (0.0, 0.1, 0.3, 0.5, 0.7, 0.9)], "z double")
    got = {r.z: r.kde_class for r in strata.assign_classes(df, strata.Manual(upper=0.4)).collect()}
    assert got == {0.0: 1, 0.1: 2, 0.3: 2, 0.5: 3, 0.7: 3, 0.9: 3}
    df = spark.createDataFrame([(z,) for z in (0.0, 0.1, 0.2, 0.4, 0.6, 0.8)], "z double")
    assert [r.kde_class for r in strata.assign_classes(df, strata.Manual(0.15, 0.55)).orderBy("z").collect()] == [1, 1, 2, 2, 3, 3]


def test_speeds(spark):
    df = spark.createDataFrame([(d,) for d in (0.0, 1.0, 0.5, -0.5, 1.5)], "d double")
    v = X.inverse_linear_speed(F.col("d"), F.lit(0.0), F.lit(1.0), 2, 8)
    assert [r.v for r in df.select(v.alias("v")).collect()] == [8, 2, 5, 8, 2]
    assert df.select(X.inverse_linear_speed(F.col("d"), F.lit(1.0), F.lit(1.0), 2, 8).alias("v")).first().v == 5
    assert [r.q for r in spark.createDataFrame([(0.125,), (0.375,)], "v double").select(X.quantise(F.col("v"), 0.25).alias("q")).collect()] == [0, 0.5]
    assert planner.is_monotone_decreasing(spark, planner.DensityGuidedSpeed())
    for bad in (lambda: planner.ConstantSpeed(0), lambda: planner.DensityGuidedSpeed(5, 2), lambda: planner.CurvatureGuidedSpeed(alpha=-1), lambda: planner.SweepSpec(0, 1, 0, 1, 0)):
        with pytest.raises(ValueError):
            bad()


def test_lawnmower(spark):
    rows = planner.sweep(spark, planner.SweepSpec(0, 100, 0, 100, 25)).orderBy("seq").collect()
    assert len(rows) == 10 and [(r.x, r.y) for r in rows[:3]] == [(0, 0), (100, 0), (100, 25)]
    rows = planner.sweep(spark, planner.SweepSpec(0, 50, 0, 100, 25, primary="y")).collect()
    assert len(rows) == 6
    assert planner.sweep(spark, planner.SweepSpec(0, 50, 0, 50, 25, start="high")).orderBy("seq").first().y == 50
    turned = planner.sweep(spark, planner.SweepSpec(0, 100, 0, 100, 50, yaw_deg=90)).orderBy("seq").first()
    assert (turned.x, turned.y) == (pytest.approx(100), pytest.approx(0))


def test_waypoints(spark):
    cells = raster.grid_cells(spark, 11, 21, 0.0, 0.0, 10.0, 10.0)
    axes = raster.Axes(0.0, 10.0, 21, 0.0, 10.0, 11)
    flat = raster.uniform_grid(cells, 0.5)
    spec = planner.SweepSpec(0, 200, 0, 100, 50)
    w = planner.plan_mission(flat, axes, planner.ConstantSpeed(4.0), spec, seconds=5.0).orderBy("seq").collect()
    first = [r for r in w if r.y == 0 and r.line_id == 1]
    assert [r.x for r in first[:4]] == [0, 20, 40, 60] and {r.speed for r in w} == {4.0}
    peak = raster.gaussian_grid(cells, [(100.0, 50.0)], [30.0], [1.0])
    g = planner.plan_mission(peak, axes, planner.CurvatureGuidedSpeed(), spec, quantum=0.25, smoothing=1, time_budget=60.0)
    rows = g.orderBy("seq").collect()
    assert rows and all(2 <= r.speed <= 8 and r.speed * 4 == int(r.speed * 4) for r in rows)
    full = planner.plan_mission(peak, axes, planner.CurvatureGuidedSpeed(), spec, include_vertices=True)
    assert full.count() > g.count()
    assert planner.filter_bbox(full, xmin=50, xmax=60).where("x < 50 or x > 60").count() == 0
    named = planner.annotate_line_ids(full, planner.sweep(spark, spec))
    assert named.where("line_id is null").count() == 0


def flight(spark, cells=None, nrows=6, ncols=26, size=4.0):
    cells = cells or raster.grid_cells(spark, nrows, ncols, 0.0, 0.0, size, size)
    return cells, raster.Axes(0.0, size, ncols, 0.0, size, nrows)


def test_waypoints_of_one_leg(spark):
    cells, axes = flight(spark)
    flat = raster.uniform_grid(cells, 0.5)
    path = spark.createDataFrame([(0, 0.0, 0.0, 1), (1, 50.0, 0.0, 1)], "seq int, x double, y double, line_id int")
    at = lambda **how: [r.x for r in planner.generate_waypoints(flat, axes, path, planner.ConstantSpeed(7.0), seconds=2.0, **how).orderBy("seq").collect()]
    assert at() == [0, 14, 28, 42, 50]
    assert at(include_vertices=False) == [14, 28, 42]
    assert at(time_budget=0.0) == [0]
    assert at(time_budget=4.0) == [0, 14, 28] and at(time_budget=4.1) == [0, 14, 28, 42]
    assert at(include_vertices=False, time_budget=2.0) == [14]
    assert at(min_step=20.0) == [0, 20, 40, 50] and at(spacing=(30.0, 40.0)) == [0, 30, 50]
    for bad in ({"smoothing": 2}, {"altitude": 0.0}, {"min_step": 0.0}, {"spacing": (3.0, 2.0)}, {"sampler": "cubic"}):
        with pytest.raises(ValueError):
            at(**bad)


@pytest.mark.parametrize("vertices", [True, False])
@pytest.mark.parametrize("budget", [None, 35.0])
@pytest.mark.parametrize("curved", [False, True])
def test_waypoints_against_one_walk_of_the_whole_path(spark, vertices, budget, curved):
    """A single loop over the path that keeps the time, with its own sampling."""
    cells, axes = flight(spark)
    surface = raster.gaussian_grid(cells, [(41.0, 9.0), (80.0, 14.0)], [9.0, 5.0], [1.0, 0.6]).persist()
    z = {(r.row, r.col): r.z for r in surface.collect()}
    lo, hi = min(z.values()), max(z.values())
    corners = [(0.0, 3.0), (97.0, 3.0), (97.0, 11.0), (97.0, 11.0), (2.0, 17.0), (2.0, 17.3)]

    def dens(x, y):
        c, r = min(max(x / 4, 0), 25), min(max(y / 4, 0), 5)
        total = 0.0
        for i in range(6):
            for j in range(26):
                total += max(0.0, 1 - abs(r - i)) * max(0.0, 1 - abs(c - j)) * z[i, j]
        return total

    def bends(x, y, ux, uy):
        g = ((dens(x + 2, y) - dens(x - 2, y)) ** 2 + (dens(x, y + 2) - dens(x, y - 2)) ** 2) ** 0.5 / 4
        return g, abs(dens(x + 2 * ux, y + 2 * uy) - 2 * dens(x, y) + dens(x - 2 * ux, y - 2 * uy)) / 4

    flown = lambda v: round(v / 0.25) * 0.25
    speed = lambda x, y: 8 - 6 * (dens(x, y) - lo) / (hi - lo)
    legs = [(p, q, ((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2) ** 0.5) for p, q in itertools.pairwise(corners)]
    legs = [(p, q, n, (q[0] - p[0]) / n, (q[1] - p[1]) / n) for p, q, n in legs if n]
    probes = []
    for p, _, n, ux, uy in legs if curved else []:
        m = min(128, max(32, int(np.ceil(n / 3))))
        probes += [bends(p[0] + ux * n * k / m, p[1] + uy * n * k / m, ux, uy) for k in range(m + 1)]
    g0, k0 = np.median(np.array(probes), axis=0) if curved else (1, 1)

    def step(x, y, v, ux, uy):
        if not curved:
            return min(max(v * 1.5, 2.0), 20.0)
        g, k = bends(x, y, ux, uy)
        return 3 + 9 / (1 + g / g0 + 1.5 * (k / k0) ** 2)

    want, clock = [], 0.0

    def walk():
        nonlocal clock
        for p, _, n, ux, uy in legs:
            if vertices:
                want.append((*p, flown(speed(*p))))
            s = step(*p, speed(*p), ux, uy)
            s = n if s > n else max(s, 0.5)
            while True:
                x, y = p[0] + ux * s, p[1] + uy * s
                v = flown(speed(x, y))
                if vertices or s < n - 1e-9 * max(n, 1):
                    clock += (((x - want[-1][0]) ** 2 + (y - want[-1][1]) ** 2) ** 0.5 if want else s) / v
                    want.append((x, y, v))
                    if budget is not None and clock >= budget:
                        return
                if s >= n:
                    break
                s += min(max(step(x, y, v, ux, uy), 0.5), n - s)

    walk()
    path = spark.createDataFrame([(i, *c, 1) for i, c in enumerate(corners)], "seq int, x double, y double, line_id int")
    strategy = planner.CurvatureGuidedSpeed(smin=3.0, smax=12.0) if curved else planner.DensityGuidedSpeed()
    got = planner.generate_waypoints(surface, axes, path, strategy, seconds=1.5, quantum=0.25, include_vertices=vertices, time_budget=budget).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(len(got)))
    assert [(r.x, r.y, r.speed) for r in got] == [pytest.approx(w, abs=1e-6) for w in want]


def test_colours(spark):
    df = spark.createDataFrame([(255, 255, 255), (0, 0, 0), (255, 0, 0)], "r int, g int, b int")
    L, a, b = X.lab(F.col("r"), F.col("g"), F.col("b"))
    rows = df.select(L.alias("L"), a.alias("a"), b.alias("b")).collect()
    assert rows[0].L == pytest.approx(100, abs=1e-3) and rows[1].L == pytest.approx(0, abs=1e-9)
    assert (rows[2].L, rows[2].a, rows[2].b) == (pytest.approx(53.24, abs=0.02), pytest.approx(80.09, abs=0.02), pytest.approx(67.2, abs=0.03))
    assert not df.agg(X.is_grey(F.col("r"), F.col("g"), F.col("b")).alias("g")).first().g


def test_clustering(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(10 * (i % 3), 0.1, 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, f array<double>")
    labels, _ = features.kmedoids(df, 3, 60)
    groups = labels.groupBy("label", (F.col("id") % 3).alias("g")).count().collect()
    assert sorted(r["count"] for r in groups) == [30, 30, 30]
    sweep = features.sweep_k(df, [2, 3, 4], 60)
    assert features.choose_k(sweep) == 3 and features.choose_k(sweep, "silhouette") == 3
    with pytest.raises(ValueError):
        features.choose_k(sweep, "guess")
    with pytest.raises(ValueError):
        features.labels_to_mask(labels, [])
    tie = spark.createDataFrame([(2, 0.5, 1.0, 1.0, 1.0), (3, 0.5, 1.0, 1.0, 1.0), (4, 0.1, 0.5, 2.0, 0.5)], "k int, silhouette double, dunn double, davies_bouldin double, calinski_harabasz double")
    assert features.choose_k(tie) == 2
    p = features.fit_projector(df, 3, pca=True, keep=0.9)
    assert len(p.axes) == 1
    assert features.explained(df, 3)[-1][2] == pytest.approx(1)


def test_morphology(spark):
    cells = [(r, c) for r in range(1, 6) for c in range(1, 6) if (r, c) != (3, 3)] + [(0, 9)]
    mask = spark.createDataFrame(cells, "row int, col int")
    comp = morphology.components(mask, 10)
    assert sorted(r["count"] for r in comp.groupBy("component").count().collect()) == [1, 24]
    assert morphology.remove_small_components(mask, 10, 5).count() == 24
    assert morphology.fill_small_holes(mask, 10, 10, 4).count() == 26
    solid = mask.union(spark.createDataFrame([(3, 3)], "row int, col int")).where("row > 0")
    assert morphology.erode(solid, 10, 10).count() == 9
    inner = solid.selectExpr("row + 1 as row", "col + 1 as col")  # away from the border, where the outside is ignored
    assert {tuple(r) for r in morphology.open_close(inner, 10, 10).collect()} == {tuple(r) for r in inner.collect()}
    snake = [(r, c) for r in range(0, 20, 2) for c in range(20)] + [(r, 19 if r % 4 == 1 else 0) for r in range(1, 19, 2)]
    assert morphology.components(spark.createDataFrame(snake, "row int, col int"), 20).select("component").distinct().count() == 1
