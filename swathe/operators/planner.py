"""Flight planning: sweep patterns, speed strategies and waypoint walks."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import inverse_linear_speed
from .raster import Axes


@dataclass(frozen=True)
class ConstantSpeed:
    v: float = 5.0

    def __post_init__(self):
        if not self.v > 0:
            raise ValueError("the speed must be positive")

    def speed(self, d: Column, dmin: Column, dmax: Column) -> Column:
        return F.lit(float(self.v))

    def value(self, d: float, dmin: float, dmax: float) -> float:
        return float(self.v)

    def bounds(self) -> tuple[float, float]:
        return self.v, self.v


@dataclass(frozen=True)
class DensityGuidedSpeed:
    vmin: float = 2.0
    vmax: float = 8.0
    dmin: float | None = None
    dmax: float | None = None

    def __post_init__(self):
        if not 0 < self.vmin <= self.vmax:
            raise ValueError("speeds must satisfy 0 < vmin <= vmax")

    def speed(self, d: Column, dmin: Column, dmax: Column) -> Column:
        lo = dmin if self.dmin is None else F.lit(self.dmin)
        hi = dmax if self.dmax is None else F.lit(self.dmax)
        return inverse_linear_speed(d, lo, hi, self.vmin, self.vmax)

    def value(self, d: float, dmin: float, dmax: float) -> float:
        lo, hi = (dmin if self.dmin is None else self.dmin), (dmax if self.dmax is None else self.dmax)
        if lo == hi:
            return (self.vmin + self.vmax) / 2
        return min(max(self.vmin + (1 - min(max((d - lo) / (hi - lo), 0.0), 1.0)) * (self.vmax - self.vmin), self.vmin), self.vmax)

    def bounds(self) -> tuple[float, float]:
        return self.vmin, self.vmax


@dataclass(frozen=True)
class CurvatureGuidedSpeed(DensityGuidedSpeed):
    """Steps shrink with the density's gradient and curvature along the line. ``grad_ref`` and
    ``curv_ref`` are the scales at which they count as one; by default their medians over the path."""

    smin: float = 2.0
    smax: float = 20.0
    alpha: float = 1.0
    eta: float = 2.0
    weight: float = 1.5
    grad_ref: float | None = None
    curv_ref: float | None = None

    def __post_init__(self):
        super().__post_init__()
        if min(self.alpha, self.eta, self.weight) < 0:
            raise ValueError("exponents and weight must not be negative")
        if not 0 < self.smin <= self.smax:
            raise ValueError("spacings must satisfy 0 < smin <= smax")

    def step(self, gradient: float, curvature: float, g0: float, k0: float) -> float:
        drag = (gradient / g0) ** self.alpha + self.weight * (abs(curvature) / k0) ** self.eta
        return _between(self.smin + (self.smax - self.smin) / (1 + drag), self.smin, self.smax)


Strategy = ConstantSpeed | DensityGuidedSpeed | CurvatureGuidedSpeed


def speed_map(surface: DataFrame, strategy: Strategy) -> DataFrame:
    ends = F.broadcast(surface.agg(F.min("z").alias("_lo"), F.max("z").alias("_hi")))  # one row
    return surface.crossJoin(ends).withColumn("speed", strategy.speed(F.col("z"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def is_monotone_decreasing(spark: SparkSession, strategy: Strategy, n: int = 100) -> bool:
    d = F.col("id") / F.lit(n - 1)
    w = Window.orderBy("id")  # n rows
    v = spark.range(n).select("id", strategy.speed(d, F.lit(0.0), F.lit(1.0)).alias("v"))
    worst = v.select((F.col("v") - F.lag("v").over(w)).alias("up")).agg(F.max("up")).first()[0]
    return worst is None or worst <= math.sqrt(2.220446049250313e-16)


@dataclass(frozen=True)
class SweepSpec:
    xmin: float
    xmax: float
    ymin: float
    ymax: float
    spacing: float = 40.0
    primary: str = "x"
    start: str = "low"
    yaw_deg: float = 0.0

    def __post_init__(self):
        if not self.spacing > 0 or self.xmax < self.xmin or self.ymax < self.ymin:
            raise ValueError("extents must be ordered and the spacing positive")
        if self.primary not in ("x", "y") or self.start not in ("low", "high"):
            raise ValueError("primary is x or y, start is low or high")


def sweep(spark: SparkSession, spec: SweepSpec) -> DataFrame:
    """Boustrophedon vertices (seq, x, y, line_id): two per line, alternating in direction."""
    along, across = ((spec.xmin, spec.xmax), (spec.ymin, spec.ymax)) if spec.primary == "x" else ((spec.ymin, spec.ymax), (spec.xmin, spec.xmax))
    lines = int(math.floor((across[1] - across[0]) / spec.spacing + 1e-9)) + 1
    k, end = F.floor(F.col("id") / 2), F.col("id") % 2
    v = F.lit(across[0]) + k * F.lit(spec.spacing) if spec.start == "low" else F.lit(across[1]) - k * F.lit(spec.spacing)
    u = F.when((k + end) % 2 == 0, F.lit(along[0])).otherwise(F.lit(along[1]))
    x, y = (u, v) if spec.primary == "x" else (v, u)
    cx, cy = (spec.xmin + spec.xmax) / 2, (spec.ymin + spec.ymax) / 2
    c, s = math.cos(math.radians(spec.yaw_deg)), math.sin(math.radians(spec.yaw_deg))
    if spec.yaw_deg:
        x, y = F.lit(cx) + (x - cx) * c - (y - cy) * s, F.lit(cy) + (x - cx) * s + (y - cy) * c
    return spark.range(2 * lines).select(F.col("id").cast("int").alias("seq"), x.cast("double").alias("x"), y.cast("double").alias("y"), (k + 1).cast("int").alias("line_id"))


def annotate_line_ids(waypoints: DataFrame, vertices: DataFrame) -> DataFrame:
    """``line_id`` by the nearest midpoint of a path segment; the vertices are few."""
    w = Window.orderBy("seq")
    mids = vertices.withColumns({"_nx": F.lead("x").over(w), "_ny": F.lead("y").over(w)}).where("_nx is not null")
    mids = mids.agg(F.array_sort(F.collect_list(F.struct("seq", ((F.col("x") + F.col("_nx")) / 2).alias("mx"), ((F.col("y") + F.col("_ny")) / 2).alias("my"), "line_id"))).alias("_m"))
    near = F.array_min(F.transform("_m", lambda s: F.struct(F.hypot(F.col("x") - s["mx"], F.col("y") - s["my"]).alias("d"), s["seq"].alias("seq"), s["line_id"].alias("line_id"))))
    return waypoints.drop("line_id").crossJoin(F.broadcast(mids)).withColumn("line_id", near["line_id"]).drop("_m")


EPS = sys.float_info.epsilon


def _between(x: float, lo: float, hi: float) -> float:
    return hi if x > hi else lo if x < lo else x


class Surface:
    """A small regular grid on the driver or in a worker; ``probe`` is the distance of its
    differences in cells."""

    def __init__(self, axes: Axes, z: np.ndarray, sampler: str = "bilinear", probe: float = 0.5):
        if sampler not in ("bilinear", "nearest"):
            raise ValueError("the sampler is bilinear or nearest")
        self.axes, self.z, self.sampler = axes, z, sampler
        self.zmin, self.zmax = float(z.min()), float(z.max())
        self.hx, self.hy = abs(axes.dx) * probe, abs(axes.dy) * probe

    def at(self, x: float, y: float) -> float:
        a, z = self.axes, self.z
        u = _between((x - a.x0) / a.dx, 0.0, a.ncols - 1.0)
        v = _between((y - a.y0) / a.dy, 0.0, a.nrows - 1.0)
        if self.sampler == "nearest":  # ties to the smaller number
            return float(z[math.ceil(v - 0.5), math.ceil(u - 0.5)])
        c, r = min(int(u), max(a.ncols - 2, 0)), min(int(v), max(a.nrows - 2, 0))
        c1, r1 = min(c + 1, a.ncols - 1), min(r + 1, a.nrows - 1)
        fx, fy = u - c, v - r
        return float((1 - fy) * ((1 - fx) * z[r, c] + fx * z[r, c1]) + fy * ((1 - fx) * z[r1, c] + fx * z[r1, c1]))

    def slope(self, x: float, y: float) -> float:
        hx, hy = self.hx, self.hy
        return math.hypot((self.at(x + hx, y) - self.at(x - hx, y)) / (2 * hx), (self.at(x, y + hy) - self.at(x, y - hy)) / (2 * hy))

    def bend(self, x: float, y: float, ux: float, uy: float) -> float:
        h = min(self.hx, self.hy)
        return (self.at(x + h * ux, y + h * uy) - 2 * self.at(x, y) + self.at(x - h * ux, y - h * uy)) / (h * h)


def reference_scales(surface: Surface, segments: list[tuple[float, float, float, float]], strategy: CurvatureGuidedSpeed, probes: int = 32) -> tuple[float, float]:
    """The strategy's own scales, or medians of gradient and absolute curvature over evenly spaced
    probes, both ends included, of all segments; 1 where there is no probe."""
    slopes, bends = [], []
    for xa, ya, xb, yb in segments:
        length = math.hypot(xb - xa, yb - ya)
        if not length or None not in (strategy.grad_ref, strategy.curv_ref):
            continue
        ux, uy = (xb - xa) / length, (yb - ya) / length
        n = min(128, max(probes, math.ceil(length / max(strategy.smin, 1.0))))
        for i in range(n + 1):
            x, y = xa + ux * (i / n * length), ya + uy * (i / n * length)
            slopes.append(surface.slope(x, y))
            bends.append(abs(surface.bend(x, y, ux, uy)))
    given = ((strategy.grad_ref, slopes), (strategy.curv_ref, bends))
    g0, k0 = (float(np.median(seen)) if ref is None and seen else 1.0 if ref is None else float(ref) for ref, seen in given)
    return max(g0, EPS), max(k0, EPS)


@dataclass(frozen=True)
class Walk:
    """How a path is walked: seconds between waypoints within the spacing, at least ``min_step``."""

    seconds: float = 1.0
    spacing: tuple[float, float] = (2.0, 20.0)
    min_step: float = 0.5
    quantum: float = 0.0
    include_vertices: bool = True

    def __post_init__(self):
        if not 0 < self.spacing[0] <= self.spacing[1] or not self.min_step > 0:
            raise ValueError("steps must be positive and the spacing ordered")


def walk_segment(surface: Surface, strategy: Strategy, a: tuple[float, float], b: tuple[float, float], walk: Walk, scales: tuple[float, float], final: bool) -> list[tuple[float, float, float, float, bool]]:
    """(x, y, speed, position, timed) along a segment: its start (a vertex takes no time), then points
    whose distance depends on the place before, the first step from the speed there, later ones from
    the speed as flown. Ends are left out unless vertices are included."""
    length = math.hypot(b[0] - a[0], b[1] - a[1])
    if not length:
        return []
    ux, uy = (b[0] - a[0]) / length, (b[1] - a[1]) / length

    def speed(x: float, y: float) -> float:
        return strategy.value(surface.at(x, y), surface.zmin, surface.zmax)

    def flown(x: float, y: float) -> float:
        v = speed(x, y)
        return v if walk.quantum <= 0 else round(v / walk.quantum) * walk.quantum

    def step(x: float, y: float, v: float) -> float:
        if isinstance(strategy, CurvatureGuidedSpeed):
            return strategy.step(surface.slope(x, y), surface.bend(x, y, ux, uy), *scales)
        return _between(v * walk.seconds, *walk.spacing)

    out = [(*a, flown(*a), 0.0, False)] if walk.include_vertices else []
    s = _between(step(*a, speed(*a)), walk.min_step, length)
    while True:
        x, y = a[0] + ux * s, a[1] + uy * s
        v = flown(x, y)
        if walk.include_vertices or s < length - max(1e-9 * max(length, 1.0), EPS):
            out.append((x, y, v, s, True))
        if s >= length:
            break
        s += _between(step(x, y, v), walk.min_step, length - s)
    near = math.sqrt(EPS)
    if final and walk.include_vertices and not (math.isclose(out[-1][0], b[0], rel_tol=near) and math.isclose(out[-1][1], b[1], rel_tol=near)):
        out.append((*b, flown(*b), length, False))
    return out


def generate_waypoints(
    surface: DataFrame,
    axes: Axes,
    vertices: DataFrame,
    strategy: Strategy,
    altitude: float = 80.0,
    spacing: tuple[float, float] = (2.0, 20.0),
    seconds: float = 1.0,
    quantum: float = 0.0,
    include_vertices: bool = True,
    time_budget: float | None = None,
    smoothing: int | None = None,
    min_step: float = 0.5,
    sampler: str = "bilinear",
    probe: float = 0.5,
) -> DataFrame:
    """Waypoints (seq, x, y, altitude, speed, line_id). Segments are walked in parallel, each by
    its own recursion; the surface is a planning grid, broadcast only below MOST_CELLS cells.

    With a time budget the first waypoint at which the time flown reaches it is the last one. Time is
    the distance from the waypoint before by the speed here; a vertex that starts a segment takes none.
    ``smoothing`` is the odd width of a moving average of the speeds."""
    if axes.nrows * axes.ncols > MOST_CELLS:
        raise ValueError(f"the planning surface has more than {MOST_CELLS} cells; resample it first")
    if not altitude > 0 or smoothing is not None and smoothing % 2 != 1:
        raise ValueError("the altitude must be positive and the smoothing odd")
    how = Walk(seconds, spacing, min_step, quantum, include_vertices)
    spark = surface.sparkSession
    cells = surface.select("row", "col", "z").toPandas()  # MOST_CELLS rows at most
    z = np.full((axes.nrows, axes.ncols), np.nan)
    z[cells["row"], cells["col"]] = cells["z"]
    if np.isnan(z).any():
        raise ValueError("the planning surface has cells without a value")
    whole = Surface(axes, z, sampler, probe)
    w = Window.orderBy("seq")  # a path has a few hundred vertices
    segs = vertices.withColumns({"xb": F.lead("x").over(w), "yb": F.lead("y").over(w), "last": F.lead("x", 2).over(w).isNull()}).where("xb is not null")
    segs = segs.select(F.col("seq").alias("segment"), F.col("x").alias("xa"), F.col("y").alias("ya"), "xb", "yb", "last", "line_id")
    scales = (1.0, 1.0)
    if isinstance(strategy, CurvatureGuidedSpeed):
        scales = reference_scales(whole, [(r.xa, r.ya, r.xb, r.yb) for r in segs.collect()], strategy)
    shared = spark.sparkContext.broadcast(whole)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        rows = walk_segment(shared.value, strategy, (float(r.xa), float(r.ya)), (float(r.xb), float(r.yb)), how, scales, bool(r["last"]))
        out = pd.DataFrame(rows, columns=["x", "y", "speed", "s", "timed"])
        out.insert(0, "k", range(len(out)))
        out.insert(0, "segment", int(r.segment))
        out["line_id"] = int(r.line_id)
        return out

    df = segs.groupBy("segment").applyInPandas(walk, "segment int, k int, x double, y double, speed double, s double, timed boolean, line_id int")
    order = Window.orderBy("segment", "k")  # one mission's waypoints: a path of bounded length
    df = df.withColumn("seq", F.row_number().over(order) - 1)
    w = Window.orderBy("seq")
    if time_budget is not None:
        leg = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.col("s"))
        df = df.withColumn("_t", F.when(F.col("timed"), leg / F.greatest("speed", F.lit(EPS))).otherwise(0.0))
        spent = F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("_spent", spent).where(F.col("_spent").isNull() | (F.col("_spent") < time_budget)).drop("_t", "_spent")
    if smoothing is not None:
        df = df.withColumn("speed", F.avg("speed").over(w.rowsBetween(-(smoothing // 2), smoothing // 2)))
    return df.select("seq", "x", "y", F.lit(float(altitude)).alias("altitude"), "speed", "line_id")


#: Cells of a surface that a plan may broadcast (about 100 MB in a worker).
MOST_CELLS = 1_000_000


def plan_mission(surface: DataFrame, axes: Axes, strategy: Strategy, spec: SweepSpec | None = None, **how) -> DataFrame:
    if spec is None:
        xs, ys = sorted((axes.x0, axes.x0 + (axes.ncols - 1) * axes.dx)), sorted((axes.y0, axes.y0 + (axes.nrows - 1) * axes.dy))
        spec = SweepSpec(*xs, *ys)
    return generate_waypoints(surface, axes, sweep(surface.sparkSession, spec), strategy, **how)


def filter_bbox(df: DataFrame, xmin=float("-inf"), xmax=float("inf"), ymin=float("-inf"), ymax=float("inf")) -> DataFrame:
    return df.where(F.col("x").between(F.lit(xmin), F.lit(xmax)) & F.col("y").between(F.lit(ymin), F.lit(ymax)))


def transformed(waypoints: DataFrame, tf: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """lat, lon by a function of Columns."""
    lat, lon = tf(F.col("x"), F.col("y"))
    return waypoints.withColumns({"lat": lat, "lon": lon})
