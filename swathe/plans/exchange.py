"""Further registered queries: rows that pass through a sink and a source, sampling and resampling,
sweeps, thresholds, bandwidths, and the tables behind figures. Files go to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import features, kde, linescan, planner, raster, stats, strata
from ..session import scratch
from ..sources import rasters, tables
from ..sources.georef import GeoTransform
from . import registry as R
from . import reports
from . import views as V
from .registry import query

_GT = GeoTransform.of([0.0, 1.0, 0.0, 30.0, 0.0, -1.0])


# --- sinks read back ------------------------------------------------------------------------


def _route(spark, d):
    return V.waypoints(spark, d).select("seq", "x", "y", F.lit(60.0).alias("altitude"), "speed", (F.col("seq") % 7).cast("int").alias("line_id"))


@query(V.WAYPOINTS + "\n--\nselect row_number() over (order by wps.seq) - 1 as seq, x, y, 60 as altitude, speed, wps.seq % 7 as line_id from wps", "", "x y altitude speed", "seq line_id")
def waypoints_csv(spark, d):
    path = scratch(spark, "waypoints")
    tables.write_waypoints(_route(spark, d), path)
    return tables.read_waypoints(spark, path)


@query(V.WAYPOINTS + '\n--\nselect x as "GridX", y as "GridY", 60 as "Height", speed as "Speed" from wps', "", "GridX GridY Height Speed")
def xy_speed_csv(spark, d):
    path = scratch(spark, "xy")
    tables.write_xy_speed(_route(spark, d), path)
    return tables.read_csv(spark, path, "GridX double, GridY double, Height double, Speed double")


@query(V.TRACK + "\n--\nselect mission, row_number() over (order by track.seq) - 1 as seq, x, y, ve, vn, time from track where mission = 'click'", "mission", "x y ve vn time", "seq")
def track_csv(spark, d):
    path = scratch(spark, "track")
    names = {"x": "GridX", "y": "GridY", "ve": "VEast", "vn": "VNorth", "time": "Time"}
    tables.write_csv(V.track(spark, d).where("mission = 'click'").drop("mission"), path, ["seq"], names)
    return tables.read_track(spark, path, "click")


@query(V.CNT + "\n--\nselect ret, cover, mission, 'NA' as kernel, r as row, c as col, n from cnt", "ret cover mission kernel", "", "row col n")
def counts_json(spark, d):
    path = scratch(spark, "counts")
    tables.write_counts_json(V.counts(spark, d), path, V.NROWS, V.NCOLS)
    return tables.read_counts_json(spark, path, V.NROWS, V.NCOLS, layout="row_major")


def _stored(name: str):
    """A registered table, written as CSV and read with its schema; the same rows."""

    def run(spark, d):
        df = R.queries()[name](spark, d)
        path = scratch(spark, name)
        tables.write_csv(df, path)
        return tables.read_csv(spark, path, ", ".join(f"`{c}` {t}" for c, t in df.dtypes))

    return run


for _name, _of in (("statistics_csv", "summary_statistics"), ("coverage_csv", "coverage_ratio"), ("strata_csv", "strata_within_cover"), ("class_summary_csv", "class_summary_manual"), ("along_track_csv", "along_track_cr"), ("line_scan_csv", "line_scan")):
    R.same_rows(_name, _of, _stored(_of))


@query(R._SURFACE + "\n--\nselect r as row, c as col, z from surf", "", "z", "row col")
def surface_files(spark, d):
    path = scratch(spark, "surface")
    rasters.save_surface(R._surface(spark, d), path, _GT, "EPSG:6348", V.NROWS, V.NCOLS, "stored")
    return rasters.load_surface(spark, path)[0]


@query(R._SURFACE + "\n--\nselect r as row, c as col, z from surf", "", "z", "row col")
def surface_csv(spark, d):
    path = scratch(spark, "surface-csv")
    rasters.save_surface_csv(R._surface(spark, d), path, _GT, "EPSG:6348", "stored")
    return rasters.load_surface_csv(spark, path)[0].select("row", "col", "z")


@query("select event_id, case when event_id % 3 = 2 then value end as v from events", "", "v", "event_id")
def finite_json(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, float("nan")).when(F.col("event_id") % 3 == 1, float("inf")).otherwise(F.col("value").cast("double"))
    rows = tables.finite_json(V.table(spark, d, "events").select("event_id", v.alias("v")))
    return rows.select(F.from_json("json", "event_id long, v double").alias("r")).select("r.*")


# --- sampling, grids, sweeps ----------------------------------------------------------------

_AXES = raster.Axes(0.0, 1.0, V.NCOLS, 0.0, 1.0, V.NROWS)


@query(R._SURFACE + "\n--\nselect event_id, surf.z as z from pts join surf on surf.c = pts.c and surf.r = least(pts.r + 1, 29)", "", "z", "event_id")
def nearest_sample(spark, d):
    p = V.points(spark, d).select("event_id", (F.col("col") + 0.3).alias("x"), (F.col("row") + 0.6).alias("y"))
    return raster.sample(p, R._surface(spark, d), _AXES, "nearest").select("event_id", "z")


_HALVES = R._SURFACE + """,
half as (select r, c, z, (z + coalesce(lead(z) over a, z)) / 2 as e, (z + coalesce(lag(z) over a, z)) / 2 as w, (z + coalesce(lead(z) over b, z)) / 2 as n, (z + coalesce(lag(z) over b, z)) / 2 as s
  from surf window a as (partition by r order by c), b as (partition by c order by r))"""


def _centres(spark):
    return raster.grid_cells(spark, V.NROWS, V.NCOLS).select("row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))


@query(_HALVES + "\n--\nselect r as row, c as col, e - w as gx, n - s as gy, sqrt((e - w) ** 2 + (n - s) ** 2) as gradient from half", "", "gx gy gradient", "row col")
def gradient_at(spark, d):
    return raster.gradient(_centres(spark), R._surface(spark, d), _AXES).select("row", "col", "gx", "gy", "gradient")


@query(_HALVES + "\n--\nselect r as row, c as col, (e - 2 * z + w) / 0.25 as curvature from half", "", "curvature", "row col")
def curvature_along_x(spark, d):
    return raster.directional_curvature(_centres(spark), R._surface(spark, d), _AXES, 1.0, 0.0).select("row", "col", "curvature")


@query("select n_nationkey, k, n_nationkey + k / 4.0 * 10 as x, k / 4.0 * 5 as y from nation, (select unnest(range(5)) as k)", "", "x y", "n_nationkey k")
def line_points(spark, d):
    key = F.col("n_nationkey").cast("double")
    segments = V.table(spark, d, "nation").select("n_nationkey", key.alias("xa"), F.lit(0.0).alias("ya"), (key + 10).alias("xb"), F.lit(5.0).alias("yb"))
    return raster.line_points(segments, 5).select("n_nationkey", "k", "x", "y")


@query(R._SURFACE + "\n--\nselect t.r as row, t.c as col, z from (select a.i as r, b.i as c from range(15) a(i), range(96) b(i)) t join surf on surf.r = round_even((t.r + 0.5) * 2 - 0.5, 0) and surf.c = round_even((t.c + 0.5) * 3 - 0.5, 0)", "", "z", "row col")
def resample_image(spark, d):
    return raster.resample_image(R._surface(spark, d), V.NROWS, V.NCOLS, raster.grid_cells(spark, 15, 96), 15, 96).select("row", "col", "z")


@query(V.CELLS + "\n--\nselect r as row, c as col, case when power((c - 143.5) / (sqrt(0.5) * 144), 2) + power((r - 14.5) / (sqrt(0.5) * 15), 2) <= 1 then 1 else 0 end as z from cells", "", "z", "row col")
def synthetic_mask(spark, d):
    return raster.mask_grid(raster.grid_cells(spark, V.NROWS, V.NCOLS), 0.5, V.NROWS, V.NCOLS).select("row", "col", "z")


@query(
    V.CELLS
    + """,
g as (select r, c, exp(-((c - 40) ** 2 + (r - 10) ** 2) / 800.0) + 0.5 * exp(-((c - 200) ** 2 + (r - 20) ** 2) / 5000.0) as z from cells)
--
select r as row, c as col, (z - (select min(z) from g)) / ((select max(z) from g) - (select min(z) from g)) as z from g""",
    "",
    "z",
    "row col",
)
def synthetic_surface(spark, d):
    return raster.gaussian_grid(raster.grid_cells(spark, V.NROWS, V.NCOLS), [(40.0, 10.0), (200.0, 20.0)], [20.0, 50.0], [1.0, 0.5]).select("row", "col", "z")


_TURNED = """l as (select i as k, e from range(6) t(i), (select unnest([0, 1]) as e)),
v as (select 2 * k + e as seq, k + 1 as line_id, 287 - k * 50.0 - 143.5 as dx, (case when (k + e) % 2 = 0 then 0 else 29 end) - 14.5 as dy from l)"""


@query(_TURNED + "\n--\nselect seq, line_id, 143.5 + dx * cos(radians(30)) - dy * sin(radians(30)) as x, 14.5 + dx * sin(radians(30)) + dy * cos(radians(30)) as y from v", "", "x y", "seq line_id")
def turned_sweep(spark, d):
    return planner.sweep(spark, planner.SweepSpec(0.0, 287.0, 0.0, 29.0, 50.0, "y", "high", 30.0))


@query(
    V.PTS
    + """,
l as (select i as k, e from range(6) t(i), (select unnest([0, 1]) as e)), v as (select 2 * k + e as seq, k + 1 as line_id, case when (k + e) % 2 = 0 then 0 else 287 end as x, k * 5.0 as y from l),
m as (select seq, line_id, (x + lead(x) over (order by seq)) / 2 as mx, (y + lead(y) over (order by seq)) / 2 as my from v),
near as (select event_id, line_id, row_number() over (partition by event_id order by (c + 0.123 - mx) ** 2 + (r + 0.377 - my) ** 2, seq) as k from pts, m where mx is not null)
--
select event_id, line_id from near where k = 1""",
    "",
    "",
    "event_id line_id",
)
def nearest_line_ids(spark, d):
    p = V.points(spark, d).select("event_id", (F.col("col") + 0.123).alias("x"), (F.col("row") + 0.377).alias("y"))
    return planner.annotate_line_ids(p, planner.sweep(spark, planner.SweepSpec(0.0, 287.0, 0.0, 29.0, 5.0))).select("event_id", "line_id")


@query("select event_id, round_even(value / 0.25, 0) * 0.25 as quantised, -5 + (event_id % 100) * 10 / 99.0 as axis, sqrt(value::double * value + (event_id % 7) ** 2) as speed from events", "", "quantised axis speed", "event_id")
def flight_expressions(spark, d):
    e = V.table(spark, d, "events")
    v = F.col("value").cast("double")
    return e.select("event_id", X.quantise(v, 0.25).alias("quantised"), X.pixel_axis(F.col("event_id") % 100, 100, -5.0, 5.0).alias("axis"), X.ground_speed(v, (F.col("event_id") % 7).cast("double")).alias("speed"))


# --- bandwidths, thresholds, choices --------------------------------------------------------

_SIGMA = R._MASK + """,
dev as (select stddev_pop(c) * pow(count(*), -1 / 6.0) as a, stddev_pop(r) * pow(count(*), -1 / 6.0) as b, greatest(1, (stddev_samp(c) + stddev_samp(r)) / 2 * pow(count(*), -1 / 6.0)) as h from mask),
sig as (select greatest(2, least(50, a)) as sx, greatest(2, least(50, b)) as sy, h from dev)"""


@query(_SIGMA + "\n--\nselect sx, sy, (sx + sy) / 2 as both, h as indices from sig", "", "sx sy both indices")
def scott_bandwidths(spark, d):
    m = R._mask(spark, d)
    return spark.createDataFrame([(*kde.scott_sigma(m, anisotropic=True), kde.scott_sigma(m)[0], kde.scott_sigma_indices(m))], "sx double, sy double, both double, indices double")


@query(
    _SIGMA
    + """,
offs as (select a.i as dr, b.i as dc, 1 - (a.i * a.i + b.i * b.i) / (h * h) as w from range(-60, 61) a(i), range(-60, 61) b(i), sig where a.i * a.i + b.i * b.i < h * h),
raw as (select m.r + dr as r, m.c + dc as c, sum(w) as z from mask m, offs group by all),
dens as (select cells.r, cells.c, coalesce(z, 0) as z from cells left join raw using (r, c))
--
select r as row, c as col, (z - (select min(z) from dens)) / ((select max(z) from dens) - (select min(z) from dens)) as z from dens""",
    "",
    "z",
    "row col",
)
def kde_epanechnikov_auto(spark, d):
    return kde.kde_from_mask(spark, R._mask(spark, d), V.NROWS, V.NCOLS, "epanechnikov")


@query(R._SURFACE + f"\n--\nselect quantile_cont(z, 0.4) as lower, quantile_cont(z, 0.8) as upper from surf where z > {strata.EPS}", "", "lower upper")
def threshold_quantile(spark, d):
    return spark.createDataFrame([strata.thresholds(R._surface(spark, d), strata.Quantile(0.4, 0.8))], "lower double, upper double")


@query(
    R._SURFACE
    + f"\n--\nselect 0.1 as lower, 0.4 as upper, count(*) filter (z > {strata.EPS}) as n_positive, count(*) filter (z <= {strata.EPS}) as n_field, min(z) filter (z > {strata.EPS}) as min, median(z) filter (z > {strata.EPS}) as median, avg(z) filter (z > {strata.EPS}) as mean, max(z) filter (z > {strata.EPS}) as max from surf",
    "",
    "lower upper min median mean max",
    "n_positive n_field",
)
def threshold_statistics(spark, d):
    r = strata.threshold_stats(R._surface(spark, d), strata.Manual(0.1, 0.4))
    names = ("lower", "upper", "min", "median", "mean", "max", "n_positive", "n_field")
    return spark.createDataFrame([tuple(r[n] for n in names)], "lower double, upper double, min double, median double, mean double, max double, n_positive long, n_field long")


@query(
    V.FEATURES
    + """,
s as (select label + 2 as k, avg(f[1]) as a, avg(f[2]) as b, avg(f[3]) as c, avg(f[4]) as e from feat group by label),
best as (select arg_max(k, a) as k from s union all select arg_max(k, b) from s union all select arg_min(k, c) from s union all select arg_max(k, e) from s),
v as (select s.k, count(best.k) as votes from s left join best on best.k = s.k group by s.k)
--
select k, votes, (select k from v order by votes desc, k limit 1) as vote, (select arg_max(k, a) from s) as by_silhouette, (select arg_min(k, c) from s) as by_db from v""",
    "",
    "",
    "k votes vote by_silhouette by_db",
)
def choose_k(spark, d):
    means = [F.avg(F.col("f")[i]).alias(n) for i, n in enumerate(("silhouette", "dunn", "davies_bouldin", "calinski_harabasz"))]
    sweep = V.features(spark, d).groupBy((F.col("label") + 2).alias("k")).agg(*means)
    chosen = {n: features.choose_k(sweep, s) for n, s in (("vote", "vote"), ("by_silhouette", "silhouette"), ("by_db", "db"))}
    return features.votes(sweep).select("k", "votes", *[F.lit(v).alias(n) for n, v in chosen.items()])


@query("select vec_id as id, label in (1, 3) as mask from embeddings", "mask", "", "id")
def labels_to_mask(spark, d):
    return features.labels_to_mask(V.features(spark, d), (1, 3)).select("id", "mask")


R.same_rows("cover_stats_table", "summary_statistics", lambda spark, d: stats.cover_stats_table(V.counts(spark, d), R._n(spark), R.KEYS))


# --- figure tables --------------------------------------------------------------------------


@query(R._STATS.format(which="false").split(",\nruns as")[0] + "\n--\nselect ret, cover, mission, Mean, ncells / 2880 as CR from base", "ret cover mission", "Mean CR")
def mean_against_cr(spark, d):
    return reports.mean_against_cr(stats.summary_statistics(V.counts(spark, d), R._n(spark), R.KEYS))


@query(R._SCAN + "\n--\nselect line_number, mission, c as col, count(*) as support, sum(hit) as covered, case when sum(hit) > 0 then log10(sum(hit)) end as log_covered from cells where line_number = 2 group by all", "mission", "log_covered", "line_number col support covered")
def overlap_detail(spark, d):
    return reports.overlap_detail(R._metrics(spark, d, line_number=2)["profile"])


_WIDE = R._SCAN + """,
scan as (select line_index, line_number, cover, mission, sum(hit) / count(*) as cr from cells group by all),
wide as (select line_number, cover, max(cr) filter (mission = 'click') - max(cr) filter (mission = 'view') as v, max(cr) filter (mission = 'click') - max(cr) filter (mission = 'error') as e from scan group by line_index, line_number, cover)"""


def _wide(spark, d):
    return linescan.wide_differences(R._metrics(spark, d)["scan"], ["click", "view", "error"], "click", ["view", "error"])


@query(_WIDE + "\n--\nselect line_number, cover, 100 * v as click_minus_view_pp, 100 * e as click_minus_error_pp from wide where v is not null and e is not null", "cover", "click_minus_view_pp click_minus_error_pp", "line_number")
def forest_differences(spark, d):
    return reports.forest_differences(_wide(spark, d), "click", ["view", "error"])


@query(_WIDE + "\n--\nselect cover, line_number, v as click_minus_view from (select *, row_number() over (partition by cover order by v desc, line_number) as k from wide where v is not null and cover in ('decid', 'conif')) where k = 1", "cover", "click_minus_view", "line_number")
def best_lines(spark, d):
    return linescan.best_lines(_wide(spark, d), "click_minus_view")


_CLASSED = R._SURFACE + ", cl as (select r, c, z, case when z <= 0.1 then 1 when z <= 0.4 then 2 else 3 end as k from surf)"


@query(_CLASSED + "\n--\nselect r as row, c as col, k as kde_class, 100 * count(*) over (partition by k) / (count(*) over ())::double as percent from cl", "", "percent", "row col kde_class")
def class_map(spark, d):
    return reports.class_map(strata.assign_classes(R._surface(spark, d), strata.Manual(0.1, 0.4))).select("row", "col", "kde_class", "percent")
