"""The registered queries and the SQL that states the same result for another engine.

Every query runs over its whole tables, but silhouette_score and dunn_index, which score a sample of
400 rows as their SQL does (the reference's default is 2,000). Doubles are rounded to six places on both sides, as sums
depend on the order of addition in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import bootstrap, coverage, features, kde, linescan, morphology, planner, raster, stats, strata
from ..operators import trajectory as T
from ..streaming import sessions
from . import reports
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
KEYS = ["ret", "cover", "mission"]


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places (and no negative zero), counts as long."""
    cols = []
    for c, t in df.dtypes:
        if t == "double":
            cols.append((F.round(F.col(c), 6) + F.lit(0.0)).alias(c))
        elif t in ("int", "smallint", "tinyint"):
            cols.append(F.col(c).cast("long").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def query(sql: str | None = None, others: str = "", doubles: str = "", longs: str = ""):
    """Registers a query, with SQL (common table expressions, then a select) if there is any."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = lambda spark, d: tidy(f(spark, d))
        if sql is not None:
            ctes, _, body = sql.rpartition("\n--\n")
            cols = [f'"{c}"' for c in others.split()] + [f'cast("{c}" as bigint) as "{c}"' for c in longs.split()] + [f'round(cast("{c}" as double), 6) + 0.0 as "{c}"' for c in doubles.split()]
            _sql[f.__name__] = (f"with {ctes}\n" if ctes else "") + f"select {', '.join(cols)} from ({body}) q"
        return f

    return add


def same_rows(name: str, of: str, f: Query) -> None:
    """Registers a query that another way leads to the rows of a registered one."""
    _queries[name] = lambda spark, d: tidy(f(spark, d))
    _sql[name] = _sql[of]


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _n(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(V.COVER_CELLS).alias("N"))


# --- coverage -------------------------------------------------------------------------------

_BASE = """base as (select ret, cover, mission, count(*) as ncells, quantile_cont(n, 0.25) as Q1, quantile_cont(n, 0.5) as Q2, quantile_cont(n, 0.75) as Q3, avg(n) as Mean, stddev_samp(n) as sd from cnt group by all),
runs as (select ret, cover, mission, n, count(*) as k from cnt group by all),
ranked as (select *, coalesce(sum(k) over (partition by ret, cover, mission order by n rows between unbounded preceding and 1 preceding), 0) as before from runs),
gini as (select ret, cover, mission, 2 * sum(n * (k * before + k * (k + 1) / 2)) / (sum(k) * sum(n * k)) - (sum(k) + 1) / sum(k) as Gini from ranked group by all),
dev as (select ret, cover, mission, r, c, n - avg(n) over (partition by ret, cover, mission) as e from cnt)"""
_MORAN = """shifts as (select a.i as dr, b.i as dc from range(-1, 2) a(i), range(-1, 2) b(i) where {which}),
crossed as (select a.ret, a.cover, a.mission, sum(a.e * b.e) as s, count(*) as w from dev a, shifts, dev b where a.ret = b.ret and a.cover = b.cover and a.mission = b.mission and b.r = a.r + dr and b.c = a.c + dc group by all),
own as (select ret, cover, mission, sum(e * e) as ss, count(*) as k from dev group by all),
moran as (select own.ret, own.cover, own.mission, case when w > 0 and ss > 0 then k / w * s / ss end as MoranI from own left join crossed using (ret, cover, mission))"""
_STATS = V.CNT + ",\n" + _BASE + ",\n" + _MORAN


@query(
    _STATS.format(which="not (a.i = 0 and b.i = 0)")
    + "\n--\nselect ret, cover, mission, ncells, Q1, Q2, Q3, Q3 - Q1 as IQR, Mean, 2880 as N, ncells / 2880 as CR, sd / Mean as CV, Gini, MoranI from base join gini using (ret, cover, mission) join moran using (ret, cover, mission)",
    "ret cover mission",
    "Q1 Q2 Q3 IQR Mean CR CV Gini MoranI",
    "ncells N",
)
def summary_statistics(spark, d):
    return stats.summary_statistics(V.counts(spark, d), _n(spark), KEYS)


@query(
    _STATS.format(which="abs(a.i) + abs(b.i) = 1") + "\n--\nselect * from moran",
    "ret cover mission",
    "MoranI",
)
def morans_i_rook(spark, d):
    return stats.morans_i(V.counts(spark, d), KEYS, stats.ROOK)


@query(
    """v as (select event_type as mission, cast(floor(value) as int) as n from events), runs as (select mission, n, count(*) as k from v group by all),
ranked as (select *, coalesce(sum(k) over (partition by mission order by n rows between unbounded preceding and 1 preceding), 0) as before from runs)
--
select mission, 2 * sum(n * (k * before + k * (k + 1) / 2)) / (sum(k) * sum(n * k)) - (sum(k) + 1) / sum(k) as Gini from ranked group by all""",
    "mission",
    "Gini",
)
def gini_coefficient(spark, d):
    return stats.gini(V.table(spark, d, "events").select(F.col("event_type").alias("mission"), F.floor("value").cast("int").alias("n")), ["mission"])


@query(V.DENSE + "\n--\nselect mission, cover, avg(case when n >= 1 then 1.0 else 0 end) as cr from dense group by all", "mission cover", "cr")
def coverage_ratio(spark, d):
    return coverage.coverage_ratio(V.dense(spark, d), ["mission", "cover"])


@query(V.CNT + "\n--\nselect ret, cover, mission, count(*) filter (n >= 2) as ncells, count(*) filter (n >= 2) / 2880 as cr from cnt group by all", "ret cover mission", "cr", "ncells")
def sparse_coverage_two_returns(spark, d):
    return coverage.sparse_coverage(V.counts(spark, d), KEYS, V.COVER_CELLS, 2)


@query(
    V.DENSE + "\n--\nselect mission, cover, 100 * count(*) filter (n between 1 and 1) / count(*) filter (n <> 0) as one, 100 * count(*) filter (n between 0 and 1) / count(*) as upto_one from dense group by all",
    "mission cover",
    "one upto_one",
)
def percent_in_bin(spark, d):
    return V.dense(spark, d).groupBy("mission", "cover").agg(coverage.percent_in_bin(1, 1).alias("one"), coverage.percent_in_bin(0, 1, True).alias("upto_one"))


@query(
    V.DENSE
    + """
--
select cover, mission, avg(case when n >= 1 then 1.0 else 0 end) as cr, coalesce(avg(n) filter (n > 0), 0) as mean, coalesce(quantile_cont(n, 0.5) filter (n > 0), 0) as median,
  100 * count(*) filter (n between 1 and 5) / count(*) filter (n <> 0) as bin_1_5, 100 * count(*) filter (n between 6 and 10) / count(*) filter (n <> 0) as bin_6_10 from dense group by all""",
    "cover mission",
    "cr mean median bin_1_5 bin_6_10",
)
def per_cover_summary(spark, d):
    out = coverage.per_cover_summary(V.dense(spark, d))
    return out.select("cover", "mission", "cr", "mean", "median", F.col("bins")["bin_1_5"].alias("bin_1_5"), F.col("bins")["bin_6_10"].alias("bin_6_10"))


@query(
    V.DENSE
    + """,
strips as (select *, unnest(case when c % 24 = 0 and c > 0 then [c // 24 - 1, c // 24] else [c // 24] end) as strip from dense)
--
select mission, strip, (strip + 0.5) * 24 as center, avg(case when n >= 1 then 1.0 else 0 end) as cr, count(*) as ncells from strips where strip < 12 group by all""",
    "mission",
    "center cr",
    "strip ncells",
)
def coverage_profile(spark, d):
    return coverage.coverage_profile(V.dense(spark, d), ["mission"], "x", 24.0)


@query(V.CNT + "\n--\nselect cover, count(*) as area, count(*) / 8640 as frac, min(r) as row_min, max(r) as row_max, min(c) as col_min, max(c) as col_max from (select distinct cover, r, c from cnt) group by all", "cover", "frac", "area row_min row_max col_min col_max")
def mask_stats(spark, d):
    return coverage.mask_stats(coverage.build_cover_masks(V.counts(spark, d)), ["cover"], V.NROWS * V.NCOLS)


@query(V.CNT + "\n--\nselect ret, cover, mission, r as row, c as col, n from cnt", "ret cover mission", "", "row col n")
def bin_points(spark, d):
    p = V.points(spark, d)
    return coverage.bin_points(p, V.classes(spark), 0.0, float(V.NROWS), 1.0, 1.0, V.NROWS, V.NCOLS).select(*KEYS, "row", "col", "n")


@query(
    V.CNT
    + """
--
select ret, cover, mission, 2880 as "Ncells", 100 * (2880 - count(*)) / 2880 as p0, 100 * count(*) filter (n = 1) / 2880 as p1, 100 * count(*) filter (n between 2 and 10) / 2880 as p2, 100 * count(*) filter (n between 11 and 25) / 2880 as p11, 100 * count(*) filter (n >= 26) / 2880 as p26 from cnt group by all""",
    "ret cover mission",
    "p0 p1 p2 p11 p26",
    "Ncells",
)
def percent_density_table(spark, d):
    names = ("p0", "p1", "p2", "p11", "p26")
    bins = [(n, lo, hi) for n, (_, lo, hi) in zip(names, coverage.DENSITY_BINS, strict=True)]
    return coverage.percent_density_table(V.counts(spark, d), V.classes(spark).groupBy("cover").agg(F.count("*").alias("ncover")), KEYS, bins)


# --- bootstrap ------------------------------------------------------------------------------

_SIDE, _BOOT = 3, 200
_TILES = 10 * 96
_HITS = (
    V.CNT
    + """,
masks as (select distinct cover, r, c from cnt),
"""
)
_DRAWS = f"draws as (select b.i as b, i.i as i, ('0x' || substr(md5('42|' || b.i || '|' || i.i), 1, 12))::bigint % {_TILES} as tile from range({_BOOT}) b(i), range((select max(n_draw) from sizes)) i(i))"


@query(
    _HITS
    + f"""cells as (select k.ret, k.cover, k.mission, m.r, m.c, case when cnt.n >= 1 then 1 else 0 end as hit from (select distinct ret, cover, mission from cnt) k join masks m using (cover)
  left join cnt on cnt.ret = k.ret and cnt.cover = k.cover and cnt.mission = k.mission and cnt.r = m.r and cnt.c = m.c),
tiles as (select ret, cover, mission, (r // {_SIDE}) * 96 + c // {_SIDE} as tile, count(*) as n_mask, sum(hit) as hit from cells group by all),
sizes as (select ret, cover, mission, sum(n_mask) as n_all, sum(hit) as all_hit, greatest(1, ceil(sum(n_mask) / {_SIDE * _SIDE}))::int as n_draw from tiles group by all),
{_DRAWS},
reps as (select t.ret, t.cover, t.mission, b, sum(t.hit) / sum(t.n_mask) as stat from draws d join tiles t using (tile) join sizes s on s.ret = t.ret and s.cover = t.cover and s.mission = t.mission where d.i < s.n_draw group by all)
--
select s.ret, s.cover, s.mission, any_value(s.all_hit / s.n_all) as estimate, quantile_cont(stat, 0.025) as lower, quantile_cont(stat, 0.975) as upper, count(*) as nboot, {_SIDE} as block_side from sizes s join reps r on r.ret = s.ret and r.cover = s.cover and r.mission = s.mission group by all""",
    "ret cover mission",
    "estimate lower upper",
    "nboot block_side",
)
def bootstrap_cr_table(spark, d):
    c = V.counts(spark, d)
    out = bootstrap.bootstrap_cr_table(c, coverage.build_cover_masks(c), KEYS, V.NROWS, V.NCOLS, nboot=_BOOT)
    return out.select(*KEYS, "estimate", "lower", "upper", "nboot", "block_side")


@query(
    _HITS
    + f"""cmp as (select 'click-view ' || ret || ' ' || cover as label, ret, cover from (select distinct ret, cover from cnt)),
cells as (select k.label, k.ret, k.cover, m.r, m.c, case when a.n >= 1 then 1 else 0 end as ha, case when b.n >= 1 then 1 else 0 end as hb from cmp k join masks m using (cover)
  left join cnt a on a.mission = 'click' and a.ret = k.ret and a.cover = k.cover and a.r = m.r and a.c = m.c
  left join cnt b on b.mission = 'view' and b.ret = k.ret and b.cover = k.cover and b.r = m.r and b.c = m.c),
tiles as (select label, ret, cover, (r // {_SIDE}) * 96 + c // {_SIDE} as tile, count(*) as n_mask, sum(ha) as ha, sum(hb) as hb from cells group by all),
sizes as (select label, ret, cover, sum(n_mask) as n_all, sum(ha) as sa, sum(hb) as sb, greatest(1, ceil(sum(n_mask) / {_SIDE * _SIDE}))::int as n_draw from tiles group by all),
{_DRAWS},
reps as (select t.label, b, sum(t.ha) / sum(t.n_mask) - sum(t.hb) / sum(t.n_mask) as stat from draws d join tiles t using (tile) join sizes s on s.label = t.label where d.i < s.n_draw group by all),
ci as (select label, quantile_cont(stat, 0.025) as lower, quantile_cont(stat, 0.975) as upper from reps group by all)
--
select label, ret, cover, sa / n_all - sb / n_all as estimate, lower, upper, lower > 0 or upper < 0 as significant from sizes join ci using (label)""",
    "label ret cover significant",
    "estimate lower upper",
)
def bootstrap_cr_difference_table(spark, d):
    c = V.counts(spark, d)
    pairs = c.select("ret", "cover").distinct().select(F.concat_ws(" ", F.lit("click-view"), "ret", "cover").alias("label"), "ret", "cover", F.lit("click").alias("mission_a"), F.lit("view").alias("mission_b"))
    out = bootstrap.bootstrap_cr_difference_table(c, coverage.build_cover_masks(c), pairs, V.NROWS, V.NCOLS, nboot=_BOOT)
    return out.select("label", "ret", "cover", "estimate", "lower", "upper", "significant")


# --- trajectories ---------------------------------------------------------------------------

_LINES = V.WAYPOINTS + """,
groups as (select round_even(y, 0) as g, median(y) as y_center, min(x) as x_min, max(x) as x_max, count(*) as n from wps group by all having count(*) >= 10 and max(x) - min(x) >= 250),
lines as (select (row_number() over (order by y_center, g) - 1) as line_index, row_number() over (order by y_center, g) as line_number, y_center, x_min, x_max, n from groups)"""
_NEAR = V.TRACK + ",\n" + _LINES + """,
near as (select t.mission, t.seq, any_value(t.x) as x, any_value(t.y) as y, any_value(t.ve) as ve, any_value(t.vn) as vn, any_value(t.time) as time, sqrt(any_value(t.ve) * any_value(t.ve) + any_value(t.vn) * any_value(t.vn)) as speed,
  arg_min(l.line_index, (abs(t.y - l.y_center), l.line_index)) as line, min(abs(t.y - l.y_center)) as cross_track_m from track t cross join lines l group by t.mission, t.seq)"""
_CAND = _NEAR + """,
cand as (select near.*, l.y_center as planned, cross_track_m <= 12 and x between l.x_min - 12 and l.x_max + 12 and abs(ve) / greatest(speed, 1e-6) >= 0.72 and speed between 1 and 9.5 as ok from near join lines l on l.line_index = near.line),
fit as (select mission, line, count(*) as k, median(y) as med from cand where ok group by all),
flag as (select c.mission, c.seq, x, y, time, speed, c.line, cross_track_m, ok, case when k >= 100 then med else planned end as fitted, case when k >= 100 then med else planned end - planned as planned_offset_m from cand c left join fit on fit.mission = c.mission and fit.line = c.line),
broke as (select *, abs(y - fitted) as tracking_error_m, case when ok and (coalesce(not lag(ok) over w, true) or lag(line) over w <> line or time - lag(time) over w > 3600) then 1 else 0 end as new from flag window w as (partition by mission order by seq)),
seg as (select *, case when ok then sum(new) over (partition by mission order by seq rows unbounded preceding) - 1 else -1 end as segment_id from broke),
legs as (select *, segment_id >= 0 and max(time) over w - min(time) over w >= 60 and max(x) over w - min(x) over w >= 0.5 and count(*) over w >= 2 as clean from seg window w as (partition by mission, segment_id))"""


def _lines(spark, d):
    return T.derive_planned_lines(V.waypoints(spark, d))


def _legs(spark, d):
    return T.clean_survey_segments(V.track(spark, d), _lines(spark, d), max_gap=3600.0, min_duration=60.0, min_span=0.5, min_samples=2)


def _clean(spark, d):
    return _legs(spark, d).where("survey_leg_clean")


@query(_LINES + "\n--\nselect * from lines", "", "y_center x_min x_max", "line_index line_number n")
def derive_planned_lines(spark, d):
    return _lines(spark, d)


@query(_NEAR + "\n--\nselect mission, seq, line as nearest_line, cross_track_m from near", "mission", "cross_track_m", "seq nearest_line")
def assign_to_planned_lines(spark, d):
    return T.assign_to_planned_lines(V.track(spark, d), _lines(spark, d)).select("mission", "seq", "nearest_line", "cross_track_m")


@query(_CAND + "\n--\nselect mission, seq, segment_id, clean as survey_leg_clean, tracking_error_m, planned_offset_m from legs", "mission survey_leg_clean", "tracking_error_m planned_offset_m", "seq segment_id")
def clean_survey_segments(spark, d):
    return _legs(spark, d).select("mission", "seq", "segment_id", "survey_leg_clean", "tracking_error_m", "planned_offset_m")


@query(
    _CAND
    + """
--
select mission, count(*) as samples, count(distinct segment_id) as segments, max(time) - min(time) as duration_s, avg(speed) as mean_speed, median(speed) as median_speed, quantile_cont(speed, 0.1) as p10_speed, quantile_cont(speed, 0.9) as p90_speed,
  median(abs(planned_offset_m)) as median_offset, quantile_cont(abs(planned_offset_m), 0.95) as p95_offset, quantile_cont(cross_track_m, 0.95) as p95_cross_track, avg(tracking_error_m) as mean_error, median(tracking_error_m) as median_error,
  quantile_cont(tracking_error_m, 0.95) as p95_error, sqrt(avg(tracking_error_m * tracking_error_m)) as rms_error from legs where clean group by all""",
    "mission",
    "duration_s mean_speed median_speed p10_speed p90_speed median_offset p95_offset p95_cross_track mean_error median_error p95_error rms_error",
    "samples segments",
)
def tracking_summary(spark, d):
    return T.tracking_summary(_clean(spark, d))


@query(
    _CAND
    + "\n--\nselect mission, line as nearest_line, count(*) as samples, median(tracking_error_m) as median_error, quantile_cont(tracking_error_m, 0.75) - quantile_cont(tracking_error_m, 0.25) as iqr_error, quantile_cont(tracking_error_m, 0.95) as p95_error, sqrt(avg(tracking_error_m * tracking_error_m)) as rms_error from legs where clean group by all",
    "mission",
    "median_error iqr_error p95_error rms_error",
    "nearest_line samples",
)
def tracking_line_summary(spark, d):
    return T.tracking_line_summary(_clean(spark, d))


@query(
    _CAND
    + "\n--\nselect mission, segment_id, any_value(line) as line, count(*) as samples, max(time) - min(time) as duration_s, max(x) - min(x) as x_span, avg(speed) as mean_speed, median(tracking_error_m) as median_error, quantile_cont(tracking_error_m, 0.95) as p95_error from legs where clean group by mission, segment_id",
    "mission",
    "duration_s x_span mean_speed median_error p95_error",
    "segment_id line samples",
)
def tracking_segment_summary(spark, d):
    return T.tracking_segment_summary(_clean(spark, d))


@query(
    _CAND
    + """,
whole as (select mission, max(time) - min(time) as raw_duration_s from track group by all), parts as (select mission, segment_id, min(time) as a, max(time) as b from legs where clean group by all),
sums as (select mission, sum(b - a) as survey_duration_s, max(b) - min(a) as survey_wall_s, count(*) as segments from parts group by all)
--
select mission, raw_duration_s, survey_duration_s, survey_wall_s, coalesce(segments, 0) as segments, survey_duration_s / raw_duration_s as survey_fraction, survey_duration_s / survey_wall_s as on_line_fraction from whole left join sums using (mission)""",
    "mission",
    "raw_duration_s survey_duration_s survey_wall_s survey_fraction on_line_fraction",
    "segments",
)
def mission_time_metrics(spark, d):
    return T.mission_time_metrics(V.track(spark, d), _clean(spark, d))


_STEPS = V.WAYPOINTS + ",\nsteps as (select *, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as d from wps window w as (partition by mission order by seq))"


@query(_STEPS + "\n--\nselect mission, seq, coalesce(d, 0) as step, round(sum(coalesce(d, 0)) over (partition by mission order by seq), 1) as distance from steps", "mission", "step distance", "seq")
def flight_line_profile(spark, d):
    return T.flight_line_profile(V.waypoints(spark, d)).select("mission", "seq", "step", F.round("distance", 1).alias("distance"))


@query(
    _STEPS
    + ", kept as (select mission, d from steps where d is not null and d <= (select 3 * median(d) from steps))\n--\nselect mission, count(*) as n, quantile_cont(d, 0.5) as median, avg(d) as mean, quantile_cont(d, 0.05) as p5, quantile_cont(d, 0.95) as p95 from kept group by all",
    "mission",
    "median mean p5 p95",
    "n",
)
def waypoint_spacing(spark, d):
    return T.waypoint_spacing(V.waypoints(spark, d))


@query(V.WAYPOINTS + "\n--\nselect mission, seq, avg(speed) over (partition by mission order by seq rows between 2 preceding and 2 following) as speed from wps", "mission", "speed", "seq")
def smooth_speeds(spark, d):
    return T.smooth_speeds(V.waypoints(spark, d), 5).select("mission", "seq", "speed")


# --- line scans -----------------------------------------------------------------------------

_EXT = _CAND + """,
ext as (select mission, line as line_index, quantile_cont(x, 0.005) as x_min_actual, quantile_cont(x, 0.995) as x_max_actual, min(x) as x_min_raw, max(x) as x_max_raw, median(y) as y_median, count(*) as samples, count(distinct segment_id) as segments from legs where ok group by all),
ovl as (select line_index, max(x_min_actual) as x0, min(x_max_actual) as x1 from ext group by all having count(distinct mission) = 5 and min(x_max_actual) > max(x_min_actual))"""
_SCAN = (
    _EXT
    + ",\n"
    + V.CNT
    + """,
bands as (select line_index, line_number, x0, x1, greatest(0, floor(y_center / 8) - 2)::int as sa, least(29, floor(y_center / 8) + 2)::int as sb from lines join ovl using (line_index)),
support as (select b.line_index, b.line_number, m.cover, m.r, m.c, (m.c + 0.5) * 1.0 as x from (select distinct cover, r, c from cnt where ret = 'all') m join bands b on 29 - m.r between sa and sb and m.c + 0.5 between x0 and x1),
cells as (select s.*, k.mission, case when g.n > 0 then 1 else 0 end as hit from support s cross join (select distinct mission from cnt) k left join cnt g on g.ret = 'ground' and g.mission = k.mission and g.cover = s.cover and g.r = s.r and g.c = s.c)"""
)


def _flown(spark, d):
    legs = _legs(spark, d).where("segment_id >= 0")
    return linescan.actual_line_extents(legs)


@query(_EXT + "\n--\nselect * from ext", "mission", "x_min_actual x_max_actual x_min_raw x_max_raw y_median", "line_index samples segments")
def actual_line_extents(spark, d):
    return _flown(spark, d)


@query(_EXT + "\n--\nselect * from ovl", "", "x0 x1", "line_index")
def common_x_overlap(spark, d):
    return linescan.common_x_overlap(_flown(spark, d), 5)


def _grid_lines(spark, d):
    """The planned lines in grid rows: eight units of y are one row."""
    return _lines(spark, d).withColumn("y_center", F.col("y_center") / 8)


def _metrics(spark, d, **how):
    c = V.counts(spark, d)
    return linescan.line_scan_cover_metrics(
        c, _grid_lines(spark, d), linescan.common_x_overlap(_flown(spark, d), 5), c.select("mission").distinct(), ymin=0.0, xmin=0.0, cell=1.0, nrows=V.NROWS, half_band_rows=2, **how
    )


@query(_SCAN + "\n--\nselect line_index, line_number, cover, mission, count(*) as support, sum(hit) as covered, sum(hit) / count(*) as cr from cells group by all", "cover mission", "cr", "line_index line_number support covered")
def line_scan(spark, d):
    return _metrics(spark, d)["scan"]


@query(_SCAN + "\n--\nselect cover, mission, count(*) as support, sum(hit) as covered, sum(hit) / count(*) as cr from cells group by all", "cover mission", "cr", "support covered")
def line_scan_cover(spark, d):
    return _metrics(spark, d)["cover"]


@query(_SCAN + "\n--\nselect line_index, line_number, cover, mission, c as col, any_value(x) as x, count(*) as support, sum(hit) as covered, sum(hit) / count(*) as cr from cells where line_number = 2 group by all", "cover mission", "x cr", "line_index line_number col support covered")
def single_line_profile(spark, d):
    return _metrics(spark, d, line_number=2)["profile"]


@query(
    _SCAN
    + """,
scan as (select line_index, line_number, cover, mission, count(*) as support, sum(hit) / count(*) as cr from cells group by all)
--
select line_index, line_number, cover, max(cr) filter (mission = 'click') as click, max(cr) filter (mission = 'view') as view, max(cr) filter (mission = 'error') as error, min(support) as min_support,
  max(cr) filter (mission = 'click') - max(cr) filter (mission = 'view') as click_minus_view, max(cr) filter (mission = 'click') - max(cr) filter (mission = 'error') as click_minus_error from scan group by all""",
    "cover",
    "click view error click_minus_view click_minus_error",
    "line_index line_number min_support",
)
def wide_differences(spark, d):
    return linescan.wide_differences(_metrics(spark, d)["scan"], ["click", "view", "error"], "click", ["view", "error"])


_ALONG = V.DENSE + ",\nalong as (select mission, cover, cast(floor((c - 10) / 5) as int) as bin, avg(case when n >= 1 then 1.0 else 0 end) as cr, count(*) as ncells, 10 + (cast(floor((c - 10) / 5) as int) + 0.5) * 5 as x_center from dense where r between 10 and 14 and c >= 10 and c < 280 group by all having count(*) >= 3)"


def _along(spark, d):
    return linescan.along_track_cr(V.dense(spark, d).where("row between 10 and 14"), ["mission", "cover"], 10.0, 280.0)


@query(_ALONG + "\n--\nselect * from along", "mission cover", "cr x_center", "bin ncells")
def along_track_cr(spark, d):
    return _along(spark, d)


@query(
    _ALONG
    + ",\nthin as (select * from along where cr > 0.3), gaps as (select *, case when x_center - lag(x_center) over (partition by mission order by x_center) > 15 then 1 else 0 end as g from thin)\n--\nselect mission, bin, x_center, sum(g) over (partition by mission order by x_center) as piece from gaps",
    "mission",
    "x_center",
    "bin piece",
)
def split_at_gaps(spark, d):
    return linescan.split_at_gaps(linescan.along_track_cr(V.dense(spark, d).where("row between 10 and 14"), ["mission"], 10.0, 280.0).where("cr > 0.3"), ["mission"]).select("mission", "bin", "x_center", "piece")


_sql["split_at_gaps"] = _sql["split_at_gaps"].replace("select mission, cover, cast(floor((c - 10)", "select mission, cast(floor((c - 10)")


@query(_ALONG + "\n--\nselect mission, cover, count(*) as bins, stddev_samp(cr) as sd, count(*) < 10 or coalesce(stddev_samp(cr), 0) < 0.01 as weak from along group by all", "mission cover weak", "sd", "bins")
def along_track_weakness(spark, d):
    return linescan.along_track_weakness(_along(spark, d), ["mission", "cover"])


@query(
    V.DENSE + "\n--\nselect mission, cover, avg(case when n >= 1 then 1.0 else 0 end) as cr, count(*) filter (n > 0) as nonzero, quantile_cont(n, 0.5) filter (n > 0) as median from dense where r between 10 and 14 group by all",
    "mission cover",
    "cr median",
    "nonzero",
)
def band_coverage(spark, d):
    out = linescan.band_coverage(V.dense(spark, d).where("row between 10 and 14"), ["mission", "cover"])
    return out.select("mission", "cover", "cr", "nonzero", F.col("quartiles")[1].alias("median"))


# --- densities, rasters, strata -------------------------------------------------------------

_H = 4
_MASK = V.CNT + ",\n" + V.CELLS + ",\nmask as (select distinct r, c from cnt where ret = 'ground' and mission = 'click')"
_EPAN = _MASK + f""",
offs as (select a.i as dr, b.i as dc, 1 - (a.i * a.i + b.i * b.i) / {_H * _H}.0 as w from range(-{_H}, {_H + 1}) a(i), range(-{_H}, {_H + 1}) b(i) where a.i * a.i + b.i * b.i < {_H * _H}),
raw as (select m.r + dr as r, m.c + dc as c, sum(w) / (select sum(w) from offs) as z from mask m, offs group by all),
dens as (select cells.r, cells.c, cells.cover, coalesce(z, 0) as z from cells left join raw using (r, c)),
kde as (select r, c, cover, (z - (select min(z) from dens)) / ((select max(z) from dens) - (select min(z) from dens)) as z from dens)"""
_SURFACE = _EPAN + ", surf as (select r, c, cover, round(z, 6) as z from kde)"


def _mask(spark, d):
    return V.counts(spark, d).where("ret = 'ground' and mission = 'click'").select("row", "col").distinct()


def _surface(spark, d):
    """Rounded, so that both engines cut the strata at the same values."""
    k = kde.kde_from_mask(spark, _mask(spark, d), V.NROWS, V.NCOLS, "epanechnikov", float(_H))
    return k.select("row", "col", (F.round("z", 6) + F.lit(0.0)).alias("z"))


@query(_EPAN + "\n--\nselect r as row, c as col, z from kde", "", "z", "row col")
def kde_epanechnikov(spark, d):
    return kde.kde_from_mask(spark, _mask(spark, d), V.NROWS, V.NCOLS, "epanechnikov", float(_H))


@query(
    _MASK
    + """,
k as (select i as o, exp(-0.5 * (i / 2.0) ** 2) / (select sum(exp(-0.5 * (j / 2.0) ** 2)) from range(-6, 7) t(j)) as w from range(-6, 7) t(i)),
raw as (select m.r + a.o as r, m.c + b.o as c, sum(a.w * b.w) as z from mask m, k a, k b group by all),
dens as (select cells.r, cells.c, coalesce(z, 0) as z from cells left join raw using (r, c))
--
select r as row, c as col, (z - (select min(z) from dens)) / ((select max(z) from dens) - (select min(z) from dens)) as z from dens""",
    "",
    "z",
    "row col",
)
def kde_gaussian(spark, d):
    return kde.kde_from_mask(spark, _mask(spark, d), V.NROWS, V.NCOLS, "gaussian", 2.0)


@query(
    _SURFACE
    + """,
p as (select event_id, least(greatest(c + 0.3141593, 0), 287) as u, least(greatest(r + 0.6180339, 0), 29) as v from pts), q as (select *, least(floor(u), 286)::int as c0, least(floor(v), 28)::int as r0 from p)
--
select event_id, (1 - (v - r0)) * ((1 - (u - c0)) * a.z + (u - c0) * b.z) + (v - r0) * ((1 - (u - c0)) * g.z + (u - c0) * h.z) as z from q join surf a on a.r = r0 and a.c = c0 join surf b on b.r = r0 and b.c = c0 + 1 join surf g on g.r = r0 + 1 and g.c = c0 join surf h on h.r = r0 + 1 and h.c = c0 + 1""",
    "",
    "z",
    "event_id",
)
def bilinear_sample(spark, d):
    p = V.points(spark, d).select("event_id", (F.col("col") + 0.3141593).alias("x"), (F.col("row") + 0.6180339).alias("y"))
    return raster.sample(p, _surface(spark, d), raster.Axes(0.0, 1.0, V.NCOLS, 0.0, 1.0, V.NROWS)).select("event_id", "z")


@query(_SURFACE + "\n--\nselect t.r as row, t.c as col, z from (select a.i as r, b.i as c from range(15) a(i), range(96) b(i)) t join surf on surf.r = round_even(t.r * 2 + 0.4, 0) and surf.c = round_even(t.c * 3 + 0.8, 0)", "", "z", "row col")
def resample_nearest(spark, d):
    target = raster.grid_cells(spark, 15, 96, 0.8, 0.4, 3.0, 2.0)
    return raster.resample_world(_surface(spark, d), raster.Axes(0.0, 1.0, V.NCOLS, 0.0, 1.0, V.NROWS), target).select("row", "col", "z")


@query(_SURFACE + "\n--\nselect a.r as row, a.c as col, avg(b.z * b.z) - avg(b.z) * avg(b.z) as local_var from surf a join surf b on b.r between a.r - 2 and a.r + 2 and b.c between a.c - 2 and a.c + 2 group by a.r, a.c", "", "local_var", "row col")
def local_variance(spark, d):
    return raster.local_variance(_surface(spark, d), 2).select("row", "col", "local_var")


@query(
    _SURFACE
    + ",\ng as (select r, c, (coalesce(lead(z) over a, z) - coalesce(lag(z) over a, z)) / 2 as gx, (coalesce(lead(z) over b, z) - coalesce(lag(z) over b, z)) / 2 as gy from surf window a as (partition by r order by c), b as (partition by c order by r))\n--\nselect r as row, c as col, sqrt(gx * gx + gy * gy) as grad_mag from g",
    "",
    "grad_mag",
    "row col",
)
def gradient_magnitude(spark, d):
    return raster.gradient_magnitude(_surface(spark, d)).select("row", "col", "grad_mag")


@query(_SURFACE + "\n--\nselect r as row, c as col, case when z <= 0 then 8 else 2 + (1 - least(1, z / (select max(z) from surf))) * 6 end as speed from surf", "", "speed", "row col")
def speed_map(spark, d):
    return planner.speed_map(_surface(spark, d), planner.DensityGuidedSpeed()).select("row", "col", "speed")


_ALLHITS = ", hits as (select distinct mission, r, c from cnt where ret = 'all'), ms as (select distinct mission from cnt)"


def _all(spark, d):
    c = V.counts(spark, d).where("ret = 'all'")
    return c, c.select("mission").distinct()


@query(
    _SURFACE
    + _ALLHITS
    + """,
e as (select quantile_cont(z, 0.25) as e1, quantile_cont(z, 0.5) as e2, quantile_cont(z, 0.75) as e3, min(z) as e0, max(z) as e4 from surf),
edges as (select list_sort(list_distinct([e0, e1, e2, e3, e4])) as l from e),
s as (select surf.*, case when z >= l[-2] then len(l) - 1 else len(list_filter(l, lambda x: x <= z)) end as stratum from surf, edges)
--
select ms.mission, stratum, min(z) as z_lo, max(z) as z_hi, count(*) as ncells, count(h.r) as ncovered, count(h.r) / count(*) as cr from s cross join ms left join hits h on h.mission = ms.mission and h.r = s.r and h.c = s.c group by all""",
    "mission",
    "z_lo z_hi cr",
    "stratum ncells ncovered",
)
def cr_by_quantile_bins(spark, d):
    return strata.cr_by_quantile_bins(_surface(spark, d), *_all(spark, d))


@query(
    _SURFACE
    + _ALLHITS
    + """,
ins as (select * from surf where cover = 'conif'), pos as (select z from ins where z > 0),
e as (select quantile_cont(z, 0.25) as e1, quantile_cont(z, 0.5) as e2, quantile_cont(z, 0.75) as e3, min(z) as e0, max(z) as e4 from pos),
edges as (select list_sort(list_distinct([e0, e1, e2, e3, e4])) as l from e),
s as (select ins.*, case when z <= 0 then 0 when z >= l[-2] then len(l) - 1 else len(list_filter(l, lambda x: x <= z)) end as stratum from ins, edges),
t as (select ms.mission, stratum, min(z) as z_lo, max(z) as z_hi, count(*) as ncells, count(h.r) as ncovered from s cross join ms left join hits h on h.mission = ms.mission and h.r = s.r and h.c = s.c group by all),
u as (select *, round(sum(ncells) over (partition by mission order by stratum) / sum(ncells) over (partition by mission), 4) as q_hi from t)
--
select mission, stratum, z_lo, z_hi, ncells, ncovered, ncovered / ncells as cr, q_hi, coalesce(lag(q_hi) over (partition by mission order by stratum), 0) as q_lo from u""",
    "mission",
    "z_lo z_hi cr q_hi q_lo",
    "stratum ncells ncovered",
)
def strata_within_cover(spark, d):
    mask = V.classes(spark).where("cover = 'conif'")
    return strata.strata_within_cover(_surface(spark, d), *_all(spark, d), mask)


@query(
    _SURFACE
    + _ALLHITS
    + """,
s as (select *, case when z <= 0.15 then 1 when z <= 0.55 then 2 else 3 end as kde_class from surf), k3 as (select unnest([1, 2, 3]) as kde_class),
t as (select ms.mission, kde_class, count(*) as ncells, count(h.r) as ncovered from s cross join ms left join hits h on h.mission = ms.mission and h.r = s.r and h.c = s.c group by all)
--
select ms.mission, kde_class, coalesce(ncells, 0) as ncells, coalesce(ncovered, 0) as ncovered, coalesce(ncovered / nullif(ncells, 0), 0) as cr, 0.15 as lower, 0.55 as upper from ms cross join k3 left join t using (mission, kde_class)""",
    "mission",
    "cr lower upper",
    "kde_class ncells ncovered",
)
def class_summary_manual(spark, d):
    return strata.class_summary(_surface(spark, d), *_all(spark, d), strata.Manual(0.15, 0.55))


_HIST = _SURFACE + """,
pos as (select z from surf where z > 1e-9), ends as (select min(z) as lo, max(z) as hi from pos),
h0 as (select greatest(0, least(floor((z - lo) / ((hi - lo) / 256)), 255))::int as bin, count(*) as n from pos, ends group by all),
h as (select i as bin, coalesce(n, 0) as n, lo + (i + 0.5) * ((hi - lo) / 256) as m from range(256) t(i) cross join ends left join h0 on bin = i),
p as (select bin, sum(n) over w as c, sum(n * m) over w as s from h window w as (order by bin)), tot as (select sum(n) as c, sum(n * m) as s from h)"""


@query(
    _HIST
    + """,
v as (select p.bin, p.c * (tot.c - p.c) * (p.s / p.c - (tot.s - p.s) / (tot.c - p.c)) ** 2 as v from p, tot where p.c > 0 and tot.c > p.c)
--
select 1e-9 as lower, lo + (arg_max(bin, (v, -bin)) + 1) * ((any_value(hi) - lo) / 256) as upper from v, ends group by lo""",
    "",
    "lower upper",
)
def threshold_otsu(spark, d):
    lower, upper = strata.thresholds(_surface(spark, d), strata.Otsu())
    return spark.createDataFrame([(lower, upper)], "lower double, upper double")


@query(
    _HIST
    + """,
v as (select a.bin as i, b.bin as j, case when a.c > 0 then a.s ** 2 / a.c else 0 end + case when b.c > a.c then (b.s - a.s) ** 2 / (b.c - a.c) else 0 end + case when tot.c > b.c then (tot.s - b.s) ** 2 / (tot.c - b.c) else 0 end as v from p a, p b, tot where a.bin < b.bin and b.bin < 255)
--
select lo + (arg_max(i, (round(v, 9), -i, -j)) + 1) * ((any_value(hi) - lo) / 256) as lower, lo + (arg_max(j, (round(v, 9), -i, -j)) + 1) * ((any_value(hi) - lo) / 256) as upper from v, ends group by lo""",
    "",
    "lower upper",
)
def threshold_multi_otsu(spark, d):
    lower, upper = strata.thresholds(_surface(spark, d), strata.MultiOtsu())
    return spark.createDataFrame([(lower, upper)], "lower double, upper double")


@query(_SURFACE + "\n--\nselect r as row, c as col, 2 + (z - (select min(z) from surf)) / ((select max(z) from surf) - (select min(z) from surf)) * 3 as z from surf", "", "z", "row col")
def rescale_density(spark, d):
    return coverage.rescale_density(_surface(spark, d), 2.0, 5.0)


# --- pixels and features --------------------------------------------------------------------

_PIX = "px as (select (event_id // 100) as row, event_id % 100 as col, (user_id * 7) % 256 as r, cast(floor(value) as int) % 256 as g, hour(ts) * 10 as b from events)"
_LAB = _PIX + """,
lin as (select row, col, list_transform([r, g, b], lambda v: case when v / 255.0 <= 0.04045 then v / 255.0 / 12.92 else ((v / 255.0 + 0.055) / 1.055) ** 2.4 end) as l from px),
xyz as (select row, col, (0.4124564 * l[1] + 0.3575761 * l[2] + 0.1804375 * l[3]) / 0.95047 as x, (0.2126729 * l[1] + 0.7151522 * l[2] + 0.0721750 * l[3]) as y, (0.0193339 * l[1] + 0.1191920 * l[2] + 0.9503041 * l[3]) / 1.08883 as z from lin),
f as (select row, col, list_transform([x, y, z], lambda t: case when t > 216 / 24389 then cbrt(t) else (t * (24389 / 27) + 16) / 116 end) as f from xyz)"""


@query(_LAB + "\n--\nselect row, col, 116 * f[2] - 16 as l, 500 * (f[1] - f[2]) as a, 200 * (f[2] - f[3]) as b from f", "", "l a b", "row col")
def rgb_to_lab(spark, d):
    f = features.pixel_features(V.pixels(spark, d))
    return f.select("row", "col", F.col("f")[0].alias("l"), F.col("f")[1].alias("a"), F.col("f")[2].alias("b"))


@query(V.FEATURES + ", flat as (select id, label, unnest(f) as v, generate_subscripts(f, 1) - 1 as j from feat)\n--\nselect j, avg(v) as mu, greatest(stddev_samp(v), 2.220446049250313e-16) as sigma from flat group by all", "", "mu sigma", "j")
def standardise_moments(spark, d):
    return features.moments(V.features(spark, d))


_CENT = V.FEATURES + """,
flat as (select id, label, unnest(f) as v, generate_subscripts(f, 1) as j from feat), cm as (select label, j, avg(v) as m, count(*) as n from flat group by all),
cent as (select label, max(n) as n, list(m order by j) as c from cm group by all)"""


@query(
    _CENT
    + """,
sp as (select feat.label, avg(list_distance(f, c)) as s from feat join cent using (label) group by all),
r as (select a.label, max((sa.s + sb.s) / list_distance(a.c, b.c)) as r from cent a join cent b on a.label <> b.label join sp sa on sa.label = a.label join sp sb on sb.label = b.label group by all)
--
select avg(r) as davies_bouldin from r""",
    "",
    "davies_bouldin",
)
def davies_bouldin(spark, d):
    return features.davies_bouldin(V.features(spark, d))


@query(
    _CENT
    + """,
g as (select list(m order by j) as g from (select j, avg(v) as m from flat group by all)), b as (select sum(n * list_distance(c, g) ** 2) as ssb, count(*) as k, sum(n) as n from cent, g), w as (select sum(list_distance(f, c) ** 2) as ssw from feat join cent using (label))
--
select (ssb / (k - 1)) / (ssw / (n - k)) as calinski_harabasz from b, w""",
    "",
    "calinski_harabasz",
)
def calinski_harabasz(spark, d):
    return features.calinski_harabasz(V.features(spark, d))


_SAMPLE = V.FEATURES + """,
smp as (select * from feat order by md5('42:' || id), id limit 400),
pairs as (select a.id as i, a.label as li, b.label as lj, list_distance(a.f, b.f) as d from smp a join smp b on a.id <> b.id)"""


def _sample(spark, d):
    """A sampling operator's own output: 400 rows by digest."""
    return features.sample_pairs(features.choose_sample(V.features(spark, d), 400))


@query(
    _SAMPLE
    + """,
m as (select i, li, lj, avg(d) as m from pairs group by all), ab as (select i, max(m) filter (li = lj) as a, min(m) filter (li <> lj) as b from m group by all)
--
select avg(case when a is null or b is null then 0 else coalesce((b - a) / nullif(greatest(a, b), 0), 0) end) as silhouette from ab""",
    "",
    "silhouette",
)
def silhouette_score(spark, d):
    return features.silhouette(_sample(spark, d))


@query(_SAMPLE + "\n--\nselect min(d) filter (li <> lj) / max(d) filter (li = lj) as dunn from pairs", "", "dunn")
def dunn_index(spark, d):
    return features.dunn(_sample(spark, d))


@query(V.FEATURES + "\n--\nselect id from feat order by md5('7:' || id), id limit 100", "", "", "id")
def choose_sample_indices(spark, d):
    return features.choose_sample(V.features(spark, d), 100, 7).select("id")


@query()
def kmedoids_labels(spark, d):
    out, _ = features.kmedoids(V.features(spark, d), 4, 400)
    return out.select("id", "label")


@query()
def pca_scores(spark, d):
    f = V.features(spark, d)
    p = features.fit_projector(f, 64, pca=True, keep=0.5)
    return f.select("id", p.column().alias("scores")).select("id", F.abs(F.col("scores")[0]).alias("first"), F.size("scores").alias("components"))


# --- planning, morphology, labels, sessions -------------------------------------------------


@query(
    """l as (select i as k from range(6) t(i)), v as (select 2 * k + e as seq, k, e from l, (select unnest([0, 1]) as e))
--
select seq, case when (k + e) % 2 = 0 then 0 else 287 end as x, k * 5.0 as y, k + 1 as line_id from v""",
    "",
    "x y",
    "seq line_id",
)
def lawnmower(spark, d):
    return planner.sweep(spark, planner.SweepSpec(0.0, 287.0, 0.0, 29.0, 5.0))


@query()
def generate_waypoints(spark, d):
    axes = raster.Axes(0.0, 1.0, V.NCOLS, 0.0, 1.0, V.NROWS)
    path = planner.sweep(spark, planner.SweepSpec(0.0, 287.0, 0.0, 29.0, 5.0))
    return planner.generate_waypoints(_surface(spark, d), axes, path, planner.CurvatureGuidedSpeed(), quantum=0.25, smoothing=3)


@query()
def mask_components(spark, d):
    return morphology.components(_mask(spark, d), V.NCOLS)


@query(
    _MASK.replace("mission = 'click'", "true")
    + """,
sh as (select a.i as dr, b.i as dc from range(-1, 2) a(i), range(-1, 2) b(i)), span as (select r, c, (case when r in (0, 29) then 2 else 3 end) * (case when c in (0, 287) then 2 else 3 end) as need from cells)
--
select m.r as row, m.c as col from mask m join span using (r, c) where need = (select count(*) from mask o where o.r between m.r - 1 and m.r + 1 and o.c between m.c - 1 and m.c + 1)""",
    "",
    "",
    "row col",
)
def erode_mask(spark, d):
    m = V.counts(spark, d).where("ret = 'ground'").select("row", "col").distinct()
    return morphology.erode(m, V.NROWS, V.NCOLS)


@query("e as (select event_type as mission, count(*) as n from events group by all)\n--\nselect mission, case mission when 'click' then 'Click' else mission end as shown, n from e", "mission shown", "", "n")
def key_labels(spark, d):
    e = V.table(spark, d, "events").groupBy(F.col("event_type").alias("mission")).agg(F.count("*").alias("n"))
    return e.select("mission", X.label(F.col("mission"), {"click": "Click"}).alias("shown"), "n")


@query(
    V.TRACK
    + """,
g as (select *, case when time - lag(time) over (partition by mission order by time, seq) >= 1800 then 1 else 0 end as new from track), s as (select *, sum(new) over (partition by mission order by time, seq) as k from g)
--
select mission, min(time) as started, max(time) as last, count(*) as samples from s group by mission, k""",
    "mission",
    "started last",
    "samples",
)
def gap_sessions(spark, d):
    return sessions.gap_sessions(V.table(spark, d, "events"), "event_type", "ts", "30 minutes").select(F.col("event_type").alias("mission"), "started", "last", "samples")


# --- figure data and further expressions ------------------------------------------------------


@query(_SURFACE + "\n--\nselect kde_class, case kde_class when 1 then 'field' when 2 then 'deciduous' else 'coniferous' end as label, count(z) as ncells, 8640 as total from (select unnest([1, 2, 3]) as kde_class) k left join (select z, case when z <= 0.15 then 1 when z <= 0.55 then 2 else 3 end as kc from surf) s on kc = kde_class group by all", "label", "", "kde_class ncells total")
def class_support(spark, d):
    return strata.class_support(strata.assign_classes(_surface(spark, d), strata.Manual(0.15, 0.55)))


@query(_SURFACE + _ALLHITS + "\n--\nselect ms.mission, count(h.r) / count(*) as weighted_cr from surf s cross join ms left join hits h on h.mission = ms.mission and h.r = s.r and h.c = s.c where s.cover = 'conif' group by all", "mission", "weighted_cr")
def weighted_cr_check(spark, d):
    return strata.weighted_cr_check(strata.strata_within_cover(_surface(spark, d), *_all(spark, d), V.classes(spark).where("cover = 'conif'")))


@query(
    """q as (select event_type as mission, quantile_cont(value, 0.25) as q1, median(value) as median, quantile_cont(value, 0.75) as q3, quantile_cont(value, 0.95) as p95, min(value) as lo, max(value) as hi, sqrt(avg(value * value)) as rms from events group by all)
--
select mission, q1, median, q3, greatest(lo, q1 - 1.5 * (q3 - q1)) as low, least(hi, q3 + 1.5 * (q3 - q1)) as high, p95, rms from q""",
    "mission",
    "q1 median q3 low high p95 rms",
)
def box_stats(spark, d):
    return reports.box_stats(V.table(spark, d, "events").withColumnRenamed("event_type", "mission"), ["mission"], "value")


@query(_SURFACE + ",\nv as (select case when z <= 0 then 8 else 2 + (1 - least(1, z / (select max(z) from surf))) * 6 end as s from surf), b as (select greatest(0, least(floor((s - 2) / (6 / 32)), 31))::int as bin, count(*) as n from v group by all)\n--\nselect bin, n, 2 + (bin + 0.5) * (6 / 32) as center from b", "", "center", "bin n")
def speed_histogram(spark, d):
    return reports.speed_histogram(_surface(spark, d), planner.DensityGuidedSpeed())


@query(
    V.WAYPOINTS + "\n--\nselect seq, x, y from wps where x between 50 and 60.5 and y between 0 and 80", "", "x y", "seq"
)
def filter_bbox(spark, d):
    return planner.filter_bbox(V.waypoints(spark, d), 50.0, 60.5, 0.0, 80.0).select("seq", "x", "y")


@query(_CENT + ",\nm as (select label as k, c from cent)\n--\nselect id, arg_min(k + 1, (round(list_distance(f, c) ** 2, 9), k)) as label from feat cross join m group by id", "", "", "id label")
def assign_medoids(spark, d):
    f = V.features(spark, d)
    centres = [r.c for r in features.centroids(f).orderBy("label").collect()]  # one per cluster
    return features.assign_medoids(f.select("id", "f"), centres).select("id", "label")


@query(
    V.FEATURES + ",\ns as (select label, count(*) as n, avg(f[1]) as a, avg(f[2]) as b, avg(f[3]) as c from feat group by all)\n--\nselect label, n, a as mean_l, b as mean_a, c as mean_b, n / sum(n) over () as frac, -b as minus_a from s",
    "",
    "mean_l mean_a mean_b frac minus_a",
    "label n",
)
def cluster_summary(spark, d):
    return features.cluster_summary(V.features(spark, d)).select("label", "n", F.col("mean_L").alias("mean_l"), "mean_a", "mean_b", "frac", "minus_a")


@query(_PIX + "\n--\nselect bool_and(abs(r - g) <= 1e-6 and abs(g - b) <= 1e-6) as grey, bool_and(abs(r - g) <= 300 and abs(g - b) <= 300) as loose from px", "grey loose")
def is_grey(spark, d):
    r, g, b = (F.col(c) for c in "rgb")
    return V.pixels(spark, d).agg(X.is_grey(r, g, b).alias("grey"), X.is_grey(r, g, b, 300).alias("loose"))


@query(_PIX + "\n--\nselect row, col, r, g, b from px where row % 3 = 0 and col % 3 = 0", "", "", "row col r g b")
def decimate(spark, d):
    return raster.decimate(V.pixels(spark, d), 3)


@query(_PIX + ",\nn as (select max(row) as last from px)\n--\nselect a.row, a.col, b.r as label from px a join px b on b.row = (a.row // 4) * 4 and b.col = (a.col // 4) * 4", "", "", "row col label")
def upsample_labels(spark, d):
    px = V.pixels(spark, d)
    nrows = px.agg(F.max("row")).first()[0] + 1
    small = raster.decimate(px, 4).select("row", "col", F.col("r").alias("label"))
    return raster.upsample_labels(small, px.select("row", "col"), 4, nrows, 100)


@query("w as (select event_type as mission, epoch_us(date_trunc('day', ts)) / 1e6 as started, count(*) as n from events group by all)\n--\nselect * from w", "mission", "started", "n")
def windowed_counts(spark, d):
    out = sessions.windowed_counts(V.table(spark, d, "events"), "event_type", "ts", "1 day")
    return out.select(F.col("event_type").alias("mission"), (F.unix_micros("start") / F.lit(1e6)).alias("started"), "n")


@query(_CAND + "\n--\nselect distinct t.mission, l.line_index as nearest_line, case when k >= 100 then med else l.y_center end as fitted_center from (select distinct mission from track) t cross join lines l left join fit on fit.mission = t.mission and fit.line = l.line_index", "mission", "fitted_center", "nearest_line")
def fitted_line_centers(spark, d):
    near = T.assign_to_planned_lines(V.track(spark, d).withColumn("speed", X.ground_speed(F.col("ve"), F.col("vn"))), _lines(spark, d))
    ok = (F.col("cross_track_m") <= 12) & F.col("x").between(F.col("_x_min") - 12, F.col("_x_max") + 12) & (F.abs("ve") / F.greatest("speed", F.lit(1e-6)) >= 0.72) & F.col("speed").between(1, 9.5)
    return T.fitted_line_centers(near, _lines(spark, d), ok)


@query(
    V.DENSE
    + """,
top as (select greatest(1.1 * quantile_cont(n, 0.95) filter (n > 0), 10) as t from dense),
b as (select mission, floor((n - 1) / ((t - 1) / 40))::int + 1 as bin, count(*) as cells from dense, top where n > 0 group by all)
--
select mission, bin, cells, cells / sum(cells) over (partition by mission) as share from b""",
    "mission",
    "share",
    "bin cells",
)
def band_histogram(spark, d):
    return reports.band_histogram(V.dense(spark, d), ["mission"])


@query(
    "t as (select * from (values (2, 0.5, 1.0, 1.0, 9.0), (3, 0.5, 2.0, 0.5, 1.0), (4, 0.1, 2.0, 2.0, 9.0)) v(k, s, u, b, c))\n--\nselect k, (case when k = 2 then 2 when k = 3 then 2 else 0 end) as votes from t",
    "",
    "",
    "k votes",
)
def index_votes(spark, d):
    rows = [(2, 0.5, 1.0, 1.0, 9.0), (3, 0.5, 2.0, 0.5, 1.0), (4, 0.1, 2.0, 2.0, 9.0)]
    sweep = spark.createDataFrame(rows, "k int, silhouette double, dunn double, davies_bouldin double, calinski_harabasz double")
    return features.votes(sweep).select("k", "votes")


@query(
    V.WAYPOINTS
    + ",\nn as (select seq, floor(x)::int as xi, x, y from wps)\n--\nselect seq, least(greatest(ceil((x - 0.5) / 10 - 0.5), 0), 39)::int as col, least(greatest(ceil((y - 0.5) / 10 - 0.5), 0), 24)::int as row from n",
    "",
    "",
    "seq col row",
)
def nearest_axis_index(spark, d):
    w = V.waypoints(spark, d)
    return w.select("seq", X.nearest_index(F.col("x"), 0.5, 10.0, 40).alias("col"), X.nearest_index(F.col("y"), 0.5, 10.0, 25).alias("row"))


@query()
def geographic_route(spark, d):
    lat, lon = X.transverse_mercator_inverse(F.col("x") + 341300.0, F.col("y") + 4774600.0, -69.0)
    return V.waypoints(spark, d).select("seq", lat.alias("lat"), lon.alias("lon"))


from . import exchange  # noqa: E402, F401  (registers its queries)
