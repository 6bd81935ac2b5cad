from __future__ import annotations

import json

import numpy as np
import pytest

from swathe.operators import raster
from swathe.plans import reports, survey
from swathe.operators import planner
from swathe.sources import config, rasters, tables
from swathe.sources.georef import GeoTransform

GT = GeoTransform.of((100.0, 1.0, 0.0, 200.0, 0.0, -1.0))


def test_geotransform():
    assert list(GT) == [100, 1, 0, 200, 0, -1] and GT[3] == 200 and len(GT) == 6
    xs, ys = GT.axes(4, 5)
    assert xs == [100.5, 101.5, 102.5, 103.5, 104.5] and ys == sorted(ys) and GT.extents(4, 5) == (100, 105, 196, 200)
    with pytest.raises(ValueError):
        GeoTransform.of((1, 2))


def test_counts_json(spark, tmp_path):
    values = list(range(1, 7))
    key = {"ret": "all", "cover": "field", "mission": "density", "kernel": "E"}
    f = tmp_path / "counts.json"
    f.write_text(json.dumps([{"key": key, "matrix": values}]))
    read = lambda layout: {(r.row, r.col): r.n for r in tables.read_counts_json(spark, str(f), 2, 3, layout=layout).collect()}
    assert read("row_major")[0, 2] == 3 and read("col_major")[0, 2] == 5 and read("col_major_flip")[0, 2] == 6
    with pytest.raises(ValueError):
        tables.read_counts_json(spark, str(f), 3, 3, layout="row_major")
    with pytest.raises(ValueError):
        tables.read_counts_json(spark, str(f), 2, 3, layout="guess")
    tables.write_counts_json(tables.read_counts_json(spark, str(f), 2, 3, layout="row_major"), str(tmp_path / "out"), 2, 3)
    back = tables.read_counts_json(spark, str(tmp_path / "out"), 2, 3, layout="row_major")
    assert {(r.row, r.col): r.n for r in back.collect()} == read("row_major")


def test_waypoints_round_trip(spark, tmp_path):
    rows = [(i, float(i), 2.0 * i, 60.0, 5.0, i % 2) for i in range(5)]
    df = spark.createDataFrame(rows, "seq int, x double, y double, altitude double, speed double, line_id int")
    tables.write_waypoints(df, str(tmp_path / "w"))
    back = tables.read_waypoints(spark, str(tmp_path / "w")).orderBy("seq").collect()
    assert [tuple(r) for r in back] == rows
    tables.write_xy_speed(df, str(tmp_path / "xy"))
    assert tables.read_waypoints(spark, str(tmp_path / "xy"), "GridX", "GridY", "Height", "Speed").first().line_id == 0
    tables.write_route(df.withColumn("x", df.x + 500000.0), str(tmp_path / "route"))
    assert tables.read_csv(spark, str(tmp_path / "route")).columns == ["lat", "lon", "AGL", "speed"]


def test_surface_round_trips(spark, tmp_path):
    s = raster.grid_cells(spark, 3, 4).selectExpr("row", "col", "(row + col) / 10.0 as z").selectExpr("row", "col", "double(z) as z")
    rasters.save_surface(s, str(tmp_path / "s"), GT, "EPSG:6348", 3, 4)
    back, meta = rasters.load_surface(spark, str(tmp_path / "s"))
    assert meta["crs"] == "EPSG:6348" and {tuple(r) for r in back.collect()} == {tuple(r) for r in s.collect()}
    rasters.save_surface_csv(s, str(tmp_path / "c"), GT, "EPSG:6348", "ok")
    cells, head = rasters.load_surface_csv(spark, str(tmp_path / "c"))
    assert head["geotransform"] == GT and head["notes"] == "ok"
    assert {(r.row, r.col, round(r.z, 9)) for r in cells.collect()} == {(r.row, r.col, round(r.z, 9)) for r in s.collect()}
    with pytest.raises(ValueError):
        rasters.save_surface(s.selectExpr("row", "col", "z + 1 as z"), str(tmp_path / "bad"), GT, "", 3, 4)


def test_tiff_and_las(spark, tmp_path):
    band = np.arange(12.0).reshape(3, 4)
    (tmp_path / "a.tif").write_bytes(rasters.encode_tiff(band, GT, -9999.0))
    got = {(r.row, r.col): r.b1 for r in rasters.read_tiff(spark, str(tmp_path / "a.tif")).collect()}
    assert got[2, 3] == 11 and len(got) == 12
    meta = rasters.tiff_metadata(spark, str(tmp_path / "a.tif"))[0]
    assert meta["geotransform"] == list(GT) and (meta["nrows"], meta["ncols"]) == (3, 4) and meta["nodata"] == "-9999"
    assert rasters.read_classes(spark, str(tmp_path / "a.tif"), {0: "decid", 1: "conif"}).count() == 2
    with pytest.raises(ValueError):
        rasters.decode_tiff(b"nothing")
    x = np.array([1.0, 2.0, 3.5])
    (tmp_path / "a.las").write_bytes(rasters.encode_las(x, x * 2, x * 0, np.array([2, 1, 2])))
    pts = rasters.read_las(spark, str(tmp_path / "a.las"), "m", box=(1.0, 2.0, 0.0, 10.0)).orderBy("x").collect()
    assert [(r.x, r.y, r.cls) for r in pts] == [(1.0, 2.0, 2), (2.0, 4.0, 1)]


def test_config(tmp_path):
    f = tmp_path / "run.toml"
    f.write_text('[paths]\nrgb = "a.tif"\n[planning]\nflightlines_spacing_m = 25.0\nunknown = 1\ntree_labels = [2, 3]\n[paths.lidar]\ndensity = "d.las"\n')
    c = config.load_inputs(f)
    assert c.track_spacing_m == 25 and c.tree_labels == (2, 3) and c.lidar["density"] == tmp_path / "d.las"
    with pytest.raises(config.MissingInput):
        config.validate(c)
    with pytest.raises(config.MissingInput):
        config.validate(config.RunInputs(), require_lidar=True)
    (tmp_path / "t.toml").write_text(config.template())
    assert config.load_inputs(tmp_path / "t.toml") == config.RunInputs(output_dir=tmp_path / "output")
    with pytest.raises(config.MissingInput):
        config.resolve(None, tmp_path / "none")


def test_survey_end_to_end_and_reports(spark, tmp_path):
    rows = [(r, c, 10, 180 if 6 <= r < 15 and 6 <= c < 15 else 20, 10 if 6 <= r < 15 and 6 <= c < 15 else 220) for r in range(20) for c in range(20)]
    px = spark.createDataFrame(rows, "row int, col int, r int, g int, b int")
    axes = raster.Axes(0.0, 1.0, 20, 0.0, 1.0, 20)
    out = survey.plan_from_pixels(px, 20, 20, axes, planner.DensityGuidedSpeed(), planner.SweepSpec(0, 19, 0, 19, 5), k=2, nsample=200, mission={"spacing": (1.0, 5.0), "seconds": 1.0})
    assert out["mask"].where("mask").count() in (81, 319) and out["waypoints"].count() > 4
    strided = survey.mask_from_pixels_strided(px, 2, 20, 20, k=2, nsample=100)
    assert strided.count() == 400
    assert reports.speed_histogram(out["surface"], planner.DensityGuidedSpeed()).count() > 1
    assert reports.ingest_preview(px, 20, 20, 10).count() == 100 and reports.lab_channels(px).count() == 400
    (tmp_path / "x.csv").write_text("a")
    assert reports.checklist(tmp_path, ["x.csv", "*.csv", "y", "z"], ["z"]) == [("x.csv", "produced"), ("*.csv", "produced_glob"), ("y", "missing"), ("z", "skipped")]
    assert "spark" in json.loads(reports.provenance({})) and reports.run_page("t", {"a": "b"}).startswith("# t")
    nan = spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")
    assert json.loads(tables.finite_json(nan).first().json) == {"a": None, "b": 1.0}


def test_sections_of_percent_densities(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("Coniferous,,\nMission,Return,0\nDensity-aware,Ground,4.08\nField,,\nMission,Return,0\nConst 2 m/s,All,1.5\n")
    rows = tables.read_percent_densities(spark, str(f)).collect()
    assert [(r.Section, r.cells["0"]) for r in rows] == [("Coniferous", "4.08"), ("Field", "1.5")]


def test_compositions(spark, tmp_path):
    counts = spark.createDataFrame([(ret, "field", m, "NA", r, c, 1 + (r + c) % 3) for ret in ("all", "ground") for m in ("density", "const2") for r in range(6) for c in range(6) if ret == "all" or r % 2], "ret string, cover string, mission string, kernel string, row int, col int, n int")
    sizes = spark.createDataFrame([("field", 36)], "cover string, N long")
    table = survey.summarize_counts(counts, sizes).collect()
    assert [(r.Return, r.Mission, r.CR) for r in table] == [("All", "Const 2 m/s", 1.0), ("All", "Density-aware", 1.0), ("Ground", "Const 2 m/s", 0.5), ("Ground", "Density-aware", 0.5)]
    from swathe.operators import bootstrap

    got = survey.inference(counts, 6, 6, bootstrap.narrative_comparisons(spark), sizes, nboot=20)
    assert got["intervals"].count() == 4 and got["differences"].count() == 2
    classes = spark.createDataFrame([(r, c, "field") for r in range(4) for c in range(4)], "row int, col int, cover string")
    pts = spark.createDataFrame([("m", "NA", 100 + c + 0.5, 200 - r - 0.5, 0.0, 2) for r in range(4) for c in range(4)], "mission string, kernel string, x double, y double, z double, cls int")
    out = survey.lidar_counts(pts, classes, GT, 4, 4)
    assert {r.CR for r in out["statistics"].collect()} == {1.0} and out["densities"].count() == 2


def test_command_line(spark, tmp_path, capsys):
    from swathe.__main__ import main

    (tmp_path / "run.toml").write_text("[planning]\nvmin = 2.0\n")
    assert main(str(tmp_path / "run.toml")) == 0 and "skipped" in capsys.readouterr().out
