"""Hand-computed values of the count statistics."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from swathe.operators import bootstrap, coverage, stats


def one(spark, n):
    return spark.createDataFrame([(n,)], "N long")


def test_gini(spark):
    rows = [("a", v) for v in (1, 2, 3, 4, 5)] + [("b", 2)] * 4 + [("c", 7), ("z", 0), ("z", 0)]
    got = {r.k: r.Gini for r in stats.gini(spark.createDataFrame(rows, "k string, n int"), ["k"]).collect()}
    assert got["a"] == pytest.approx(4 / 15)
    assert got["b"] == pytest.approx(0) and got["c"] == pytest.approx(0) and got["z"] == 0


@pytest.mark.parametrize("rows, expected", [([[1, 2], [3, 4]], -1 / 3), ([[5, 5, 0], [5, 0, 1], [0, 1, 1]], 0.5), ([[2, 2], [2, 2]], None), ([[3, 0], [0, 0]], None)])
def test_morans_i(matrix, rows, expected):
    got = stats.morans_i(matrix(rows, k="x").where("n > 0"), ["k"]).first().MoranI
    assert got is None if expected is None else got == pytest.approx(expected)


def test_rook_neighbours_differ_from_queen(matrix):
    cells = matrix([[1, 2, 3], [2, 5, 1]], k="x")
    assert stats.morans_i(cells, ["k"], stats.ROOK).first().MoranI != pytest.approx(stats.morans_i(cells, ["k"]).first().MoranI)


def test_summary(spark, matrix):
    r = stats.summary_statistics(matrix([[0, 0, 3], [0, 5, 2], [1, 0, 4]], k="x"), one(spark, 9), ["k"]).first()
    assert (r.ncells, r.N, r.Q1, r.Q2, r.Q3, r.IQR, r.Mean) == (5, 9, 2, 3, 4, 2, 3)
    assert r.CR == pytest.approx(5 / 9) and r.CV == pytest.approx(0.5270462766947299) and r.Gini == pytest.approx(4 / 15)


def test_summary_of_a_key_without_points(spark, matrix):
    support = spark.createDataFrame([("x", 4), ("y", 4)], "k string, N long")
    r = stats.summary_statistics(matrix([[1, 2], [0, 4]], k="x"), support, ["k"]).where("k = 'y'").first()
    assert (r.ncells, r.CR, r.CV, r.Gini, r.MoranI) == (0, 0.0, 0.0, 0.0, None)
    c = stats.cover_stats_table(matrix([[1, 2], [0, 4]], k="x"), support, ["k"]).where("k = 'y'").first()
    assert math.isnan(c.CV) and math.isnan(c.Gini)


def test_partial_mask_and_single_cell(spark, matrix):
    cells = matrix([[0, 1, 2], [3, 4, 5], [6, 7, 8]], k="x").where("row = 0 or (row = 1 and col = 0)")
    r = stats.summary_statistics(cells, one(spark, 4), ["k"]).first()
    assert (r.ncells, r.N, r.Q1, r.Q2, r.Q3, r.Mean, r.CR, r.CV) == (3, 4, 1.5, 2, 2.5, 2, 0.75, 0.5)
    assert r.Gini == pytest.approx(2 / 9)
    assert stats.summary_statistics(matrix([[3]], k="x"), one(spark, 1), ["k"]).first().CV is None


def test_bins_and_density(matrix):
    grid = matrix([[3] * 10] * 5 + [[8] * 10] * 5, k="x")
    r = grid.groupBy("k").agg(*[coverage.percent_in_bin(a, b).alias(f"b{a}") for a, b in ((1, 5), (6, 10), (11, 20))]).first()
    assert (r.b1, r.b6, r.b11) == (50, 50, 0)
    s = coverage.density_bin_summary(grid, ["k"]).first()
    assert s.cr == 1 and s["mean"] == 5.5 and s["median"] == 5.5 and s.bins["bin_1_5"] == 50
    assert coverage.coverage_ratio(matrix([[0, 0]], k="x"), ["k"]).first().cr == 0


def test_profile_counts_inner_edges_twice(matrix):
    grid = matrix([[1, 1, 0, 0, 1]], k="x").withColumn("x", F.col("col").cast("double"))
    rows = {r.strip: (r.cr, r.ncells) for r in coverage.coverage_profile(grid, ["k"], "x", 2.0).collect()}
    assert rows == {0: (pytest.approx(2 / 3), 3), 1: (pytest.approx(1 / 3), 3)}


def test_rescale(matrix):
    flat = coverage.rescale_density(matrix([[3, 3]], "z", "double")).collect()
    assert {r.z for r in flat} == {0.5}
    up = coverage.rescale_density(matrix([[1, 2, 3]], "z", "double")).orderBy("col").collect()
    assert [r.z for r in up] == [0, 0.5, 1]


def test_binning_points(spark):
    classes = spark.createDataFrame([(r, c, "field" if r < 2 else "conif") for r in range(4) for c in range(4)], "row int, col int, cover string")
    pts = [("m", 100 + c + 0.5, 104 - r - 0.5, 2 if c else 1) for r in range(4) for c in range(4)] + [("m", 99.0, 100.5, 2)]
    got = coverage.bin_points(spark.createDataFrame(pts, "mission string, x double, y double, cls int"), classes, 100.0, 104.0, 1.0, 1.0, 4, 4)
    assert got.where("ret = 'all'").count() == 16 and got.where("ret = 'ground'").count() == 12
    support = classes.groupBy("cover").agg(F.count("*").alias("ncover"))
    d = coverage.percent_density_table(got, support, ["ret", "cover", "mission"]).where("ret = 'ground' and cover = 'field'").first()
    assert d["0"] == 25 and d["1"] == 75


def test_block_side():
    assert bootstrap.block_side(324, 263) == 9 and bootstrap.n_tiles(324, 263, 9) == 1080
    assert bootstrap.block_side(8, 8, 1e-6) == 1 and bootstrap.block_side(8, 8, 10) == 8


def test_bootstrap_interval(spark, matrix):
    cells = matrix([[1] * 10] * 5 + [[0] * 10] * 5, "hit", k="x")
    a = bootstrap.bootstrap_cr(cells, ["k"], 10, 10, nboot=200, frac=0.2).first()
    assert a.estimate == 0.5 and 0 <= a.lower <= a.estimate <= a.upper <= 1 and len(a.replicates) == a.nboot
    again = bootstrap.bootstrap_cr(cells.repartition(3), ["k"], 10, 10, nboot=200, frac=0.2).first()
    assert again.replicates == a.replicates
    full = bootstrap.bootstrap_cr(matrix([[1] * 8] * 8, "hit", k="x"), ["k"], 8, 8, nboot=50).first()
    assert (full.estimate, full.lower, full.upper) == (1, 1, 1)


def test_bootstrap_of_an_empty_mask(spark, matrix):
    assert bootstrap.bootstrap_cr(matrix([[1]], "hit", k="x").where("false"), ["k"], 5, 5, nboot=10).count() == 0


def test_paired_bootstrap(spark):
    rows = [("x", r, c, 1, int(r < 10)) for r in range(20) for c in range(20)]
    cells = spark.createDataFrame(rows, "k string, row int, col int, hit_a int, hit_b int")
    a = bootstrap.bootstrap_cr(cells, ["k"], 20, 20, nboot=200, frac=0.1, paired=True).first()
    assert a.estimate == 0.5 and a.lower > 0
    b = bootstrap.bootstrap_cr(cells.select("k", "row", "col", F.col("hit_b").alias("hit_a"), F.col("hit_a").alias("hit_b")), ["k"], 20, 20, nboot=200, frac=0.1, paired=True).first()
    assert b.estimate == -0.5 and b.upper < 0


def test_comparisons_skip_missing_records(spark):
    counts = spark.createDataFrame([("all", "field", m, r, 0, 1) for m in ("density", "const2") for r in range(6)], "ret string, cover string, mission string, row int, col int, n int")
    out = bootstrap.bootstrap_cr_difference_table(counts, coverage.build_cover_masks(counts), bootstrap.narrative_comparisons(spark), 6, 1, nboot=20)
    assert [r.mission_b for r in out.collect()] == ["const2"]


def test_band_histogram_goes_on_above_its_top_bin(spark):
    from swathe.plans import reports

    counts = [1] * 50 + [5] * 45 + [10] * 4 + [40]
    cells = spark.createDataFrame([("a", n) for n in counts], "mission string, n long")
    got = {r.bin: r.cells for r in reports.band_histogram(cells, ["mission"]).collect()}
    width = (10 - 1) / 40  # the top is 10: 1.1 times the 95 % quantile is less
    assert got == {math.floor((n - 1) / width) + 1: counts.count(n) for n in set(counts)} and max(got) == 174


def test_components_of_a_long_path_need_few_rounds(spark, monkeypatch):
    from swathe.operators import graph

    written = []

    def count(df, tag, write=graph.materialize):
        written.append(tag)
        assert len(written) < 30
        return write(df, tag)

    monkeypatch.setattr(graph, "materialize", count)
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(301, 300)], "a long, b long")
    got = {(r.node, r.comp) for r in graph.components(edges).collect()}
    assert got == {(i, 0) for i in range(201)} | {(300, 300), (301, 300)}
