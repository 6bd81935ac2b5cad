"""python -m swathe CONFIG.toml: plans the missions of a configuration.

Stages whose inputs are not named are skipped with a line that says so; an input that is named but
missing is an error.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import planner, raster
from .plans import reports, survey
from .session import ship_package
from .sources import config, rasters, tables


def main(path: str) -> int:
    inputs = config.validate(config.load_inputs(path))
    spark = SparkSession.builder.appName("swathe").getOrCreate()
    ship_package(spark)
    out = str(inputs.output_dir)
    if inputs.rgb is None:
        print("planning skipped: no image is named")
        return 0
    meta = rasters.tiff_metadata(spark, str(inputs.rgb))[0]
    nrows, ncols, (x0, dx, _, y0, _, dy) = meta["nrows"], meta["ncols"], meta["geotransform"]
    axes = raster.Axes(x0 + dx / 2, dx, ncols, y0 + dy / 2, dy, nrows)
    xs, ys = sorted((axes.x0, axes.x0 + (ncols - 1) * dx)), sorted((axes.y0, axes.y0 + (nrows - 1) * dy))
    spec = planner.SweepSpec(*xs, *ys, inputs.track_spacing_m)
    guided = planner.DensityGuidedSpeed(inputs.vmin, inputs.vmax)
    got = survey.plan_from_pixels(
        rasters.read_rgb(spark, str(inputs.rgb)), nrows, ncols, axes, guided, spec, inputs.kernel,
        stride=inputs.stride, mission={"altitude": inputs.altitude_m}, nsample=inputs.nsample, seed=inputs.seed, tree_labels=inputs.tree_labels, ks=range(inputs.kmin, inputs.kmax + 1),
    )
    rasters.save_surface(got["surface"], f"{out}/surface", rasters.GeoTransform(x0, dx, 0.0, y0, 0.0, dy), "", nrows, ncols)
    tables.write_waypoints(got["waypoints"], f"{out}/waypoints_density")
    for v in (inputs.vmin, inputs.vmax):
        plan = planner.plan_mission(got["surface"], axes, planner.ConstantSpeed(v), spec, altitude=inputs.altitude_m)
        tables.write_waypoints(plan, f"{out}/waypoints_constant_{v:g}")
    if inputs.lidar and inputs.gli_classes is not None:
        codes = {v: k for k, v in inputs.gli_class_codes.items()}
        classes = rasters.read_classes(spark, str(inputs.gli_classes), codes)
        grid = rasters.tiff_metadata(spark, str(inputs.gli_classes))[0]
        points = None
        for mission, file in inputs.lidar.items():
            p = rasters.read_las(spark, str(file), mission)
            points = p if points is None else points.unionByName(p)
        counted = survey.lidar_counts(points, classes, rasters.GeoTransform.of(grid["geotransform"]), grid["nrows"], grid["ncols"])
        tables.write_counts_json(counted["counts"], f"{out}/counts", grid["nrows"], grid["ncols"])
        for name in ("densities", "statistics"):
            tables.write_csv(counted[name].select(*[F.col(f"`{c}`") for c in counted[name].columns]), f"{out}/{name}")
    else:
        print("counts skipped: no point clouds or no class raster are named")
    print(reports.planning_metadata(inputs=str(inputs), rows=nrows, columns=ncols))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1]))
