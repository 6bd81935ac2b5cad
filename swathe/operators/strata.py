"""Density strata and threshold classes of a KDE surface, and coverage inside them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ratio_or_zero

CLASS_LABELS = {1: "field", 2: "deciduous", 3: "coniferous"}
EPS = 1e-9
BINS = 256


def quantile_edges(surface: DataFrame, n_bins: int, where: str = "true") -> list[float]:
    """n_bins + 1 linear-interpolated quantiles of z (a few numbers on the driver)."""
    qs = [i / n_bins for i in range(n_bins + 1)]
    edges = surface.where(where).agg(F.percentile("z", F.array(*[F.lit(q) for q in qs])).alias("e")).first().e
    return list(edges) if edges else []


def stratum_of(z: Column, edges: Sequence[float]) -> Column:
    """Number of the bin [lo, hi), the last closed; duplicate edges must be gone."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        top = z <= edges[i + 1] if i == len(edges) - 2 else z < edges[i + 1]
        out = F.when((z >= edges[i]) & top, F.lit(i + 1)).otherwise(out)
    return out


def _with_hits(surface: DataFrame, counts: DataFrame, missions: DataFrame, min_returns: int) -> DataFrame:
    hit = counts.groupBy("mission", "row", "col").agg((F.sum("n") >= min_returns).cast("int").alias("hit"))
    cells = surface.crossJoin(F.broadcast(missions))  # the missions are a handful
    return cells.join(hit, ["mission", "row", "col"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def cr_by_quantile_bins(surface: DataFrame, counts: DataFrame, missions: DataFrame, n_bins: int = 4, min_returns: int = 1) -> DataFrame:
    """Coverage per mission and quantile stratum of the whole surface."""
    edges = quantile_edges(surface, n_bins)
    unique = [e for i, e in enumerate(edges) if i == 0 or e > edges[i - 1]]
    if len(unique) == 1:
        unique = unique * 2
    df = _with_hits(surface, counts, missions, min_returns).withColumn("stratum", stratum_of(F.col("z"), unique)).where("stratum is not null")
    return df.groupBy("mission", "stratum").agg(F.min("z").alias("z_lo"), F.max("z").alias("z_hi"), F.count("*").alias("ncells"), F.sum("hit").alias("ncovered"), ratio_or_zero(F.sum("hit"), F.count("*")).alias("cr"))


def strata_within_cover(surface: DataFrame, counts: DataFrame, missions: DataFrame, mask: DataFrame, n_pos_bins: int = 4, min_returns: int = 1) -> DataFrame:
    """Strata inside a mask: 0 where z = 0, then quantile bins of the positive values. With one
    positive value there is one closed stratum. q_lo and q_hi are shares of the mask's cells."""
    inside = surface.join(mask.select("row", "col").distinct(), ["row", "col"], "left_semi")
    edges = quantile_edges(inside, n_pos_bins, "z > 0")
    unique = [e for i, e in enumerate(edges) if i == 0 or e > edges[i - 1]]
    if len(unique) == 1:
        unique = unique * 2
    stratum = F.when(F.col("z") <= 0, F.lit(0)).otherwise(stratum_of(F.col("z"), unique) if unique else F.lit(None).cast("int"))
    df = _with_hits(inside, counts, missions, min_returns).withColumn("stratum", stratum)
    out = df.groupBy("mission", "stratum").agg(F.min("z").alias("z_lo"), F.max("z").alias("z_hi"), F.count("*").alias("ncells"), F.sum("hit").alias("ncovered"), ratio_or_zero(F.sum("hit"), F.count("*")).alias("cr"))
    w = Window.partitionBy("mission").orderBy("stratum")
    upto = F.sum("ncells").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("ncells").over(Window.partitionBy("mission"))
    return out.withColumn("q_hi", F.round(upto, 4)).withColumn("q_lo", F.coalesce(F.lag("q_hi").over(w), F.lit(0.0)))


def weighted_cr_check(strata: DataFrame) -> DataFrame:
    """Coverage of the whole from the strata, weighted by their cells."""
    return strata.groupBy("mission").agg(ratio_or_zero(F.sum(F.col("cr") * F.col("ncells")), F.sum("ncells")).alias("weighted_cr"))


def histogram(values: DataFrame, lo: float, hi: float, bins: int = BINS) -> DataFrame:
    """(bin, n) of z over equal bins of [lo, hi], the last closed."""
    k = F.least(F.floor((F.col("z") - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return values.groupBy(F.greatest(F.lit(0), k).alias("bin")).agg(F.count("*").alias("n"))


def _positive_histogram(surface: DataFrame, eps: float) -> tuple[list[int], float, float]:
    ends = surface.where(F.col("z") > eps).agg(F.min("z").alias("lo"), F.max("z").alias("hi")).first()
    if ends.lo is None:
        return [0] * BINS, 0.0, 0.0
    if ends.lo == ends.hi:
        return [1] + [0] * (BINS - 1), ends.lo, ends.hi
    n = [0] * BINS
    for r in histogram(surface.where(F.col("z") > eps), ends.lo, ends.hi).collect():  # 256 rows at most
        n[r.bin] = r.n
    return n, ends.lo, ends.hi


def otsu(n: Sequence[int], lo: float, hi: float) -> float:
    """The right edge of the bin that maximises the variance between two classes, the first best."""
    width = (hi - lo) / len(n)
    mid = [lo + (i + 0.5) * width for i in range(len(n))]
    total, whole = sum(n), sum(a * b for a, b in zip(n, mid, strict=True))
    best, at, w0, s0 = -1.0, 0, 0, 0.0
    for i, (c, m) in enumerate(zip(n, mid, strict=True)):
        w0, s0 = w0 + c, s0 + c * m
        w1 = total - w0
        if w0 and w1:
            v = w0 * w1 * (s0 / w0 - (whole - s0) / w1) ** 2
            if v > best:
                best, at = v, i
    return lo + (at + 1) * width


def otsu3(n: Sequence[int], lo: float, hi: float) -> tuple[float, float]:
    """Two thresholds: the right edges of the first pair of bins with the largest variance between
    three classes; prefix sums make each pair a few operations."""
    width = (hi - lo) / len(n)
    c, s = [0.0], [0.0]
    for i, k in enumerate(n):
        c.append(c[-1] + k)
        s.append(s[-1] + k * (lo + (i + 0.5) * width))
    part = lambda a, b: (s[b] - s[a]) ** 2 / (c[b] - c[a]) if c[b] > c[a] else 0.0
    best, at, last = -1.0, (0, 1), len(n)
    for i in range(1, last - 1):
        left = part(0, i)
        for j in range(i + 1, last):
            v = left + part(i, j) + part(j, last)
            if v > best:
                best, at = v, (i, j)
    return lo + at[0] * width, lo + at[1] * width


@dataclass(frozen=True)
class MultiOtsu:
    pass


@dataclass(frozen=True)
class Otsu:
    pass


@dataclass(frozen=True)
class Quantile:
    lower: float = 1 / 3
    upper: float = 2 / 3

    def __post_init__(self):
        if not 0 <= self.lower <= self.upper <= 1:
            raise ValueError("quantiles must be ordered within [0, 1]")


@dataclass(frozen=True)
class Manual:
    lower: float = 0.0
    upper: float = 0.5

    def __post_init__(self):
        if not 0 <= self.lower < self.upper:
            raise ValueError("thresholds must be ordered and not negative")


Method = MultiOtsu | Otsu | Quantile | Manual


def thresholds(surface: DataFrame, method: Method, eps: float = EPS) -> tuple[float, float]:
    if isinstance(method, Manual):
        return (method.lower if method.lower > 0 else eps), method.upper
    if isinstance(method, Quantile):
        q = surface.where(F.col("z") > eps).agg(F.percentile("z", F.array(F.lit(method.lower), F.lit(method.upper))).alias("q")).first().q
        lower, upper = q if q else (1e-6, 1e-6)
        return max(lower, eps), max(upper, lower + eps)
    n, lo, hi = _positive_histogram(surface, eps)
    if isinstance(method, Otsu):
        return eps, max(otsu(n, lo, hi), eps)
    t1, t2 = otsu3(n, lo, hi)
    t1 = max(t1, eps)
    return t1, max(t2, t1 + eps)


def threshold_stats(surface: DataFrame, method: Method, eps: float = EPS) -> dict[str, float | int | None]:
    lower, upper = thresholds(surface, method, eps)
    p = F.when(F.col("z") > eps, F.col("z"))
    r = surface.agg(F.count(p).alias("n_positive"), F.count_if(F.col("z") <= eps).alias("n_field"), F.min(p).alias("min"), F.median(p).alias("median"), F.avg(p).alias("mean"), F.max(p).alias("max")).first()
    return {"lower": lower, "upper": upper, **r.asDict()}


def class_of(z: Column, lower: float, upper: float) -> Column:
    return F.when(z <= lower, 1).when(z <= upper, 2).otherwise(3).cast("tinyint")


def assign_classes(surface: DataFrame, method: Method = MultiOtsu(), eps: float = EPS) -> DataFrame:  # noqa: B008
    lower, upper = thresholds(surface, method, eps)
    return surface.withColumn("kde_class", class_of(F.col("z"), lower, upper))


def class_support(classes: DataFrame) -> DataFrame:
    """Cells of each of the three classes, present or not, and the total."""
    three = classes.sparkSession.createDataFrame([(k, v) for k, v in CLASS_LABELS.items()], "kde_class tinyint, label string")
    got = classes.groupBy("kde_class").agg(F.count("*").alias("ncells"))
    out = F.broadcast(three).join(got, "kde_class", "left").withColumn("ncells", F.coalesce("ncells", F.lit(0)))
    return out.withColumn("total", F.sum("ncells").over(Window.partitionBy()))  # three rows


def class_cr(classes: DataFrame, counts: DataFrame, missions: DataFrame, min_returns: int = 1) -> DataFrame:
    """Coverage per mission and class; all three classes have a row."""
    df = _with_hits(classes, counts, missions, min_returns).groupBy("mission", "kde_class").agg(F.count("*").alias("ncells"), F.sum("hit").alias("ncovered"))
    three = classes.sparkSession.createDataFrame([(k,) for k in CLASS_LABELS], "kde_class tinyint")
    every = missions.crossJoin(F.broadcast(three))
    out = every.join(df, ["mission", "kde_class"], "left").na.fill(0, ["ncells", "ncovered"])
    return out.withColumn("cr", ratio_or_zero(F.col("ncovered"), F.col("ncells")))


def class_summary(surface: DataFrame, counts: DataFrame, missions: DataFrame, method: Method = MultiOtsu(), eps: float = EPS) -> DataFrame:  # noqa: B008
    """Thresholds once, then three rows per mission."""
    lower, upper = thresholds(surface, method, eps)
    classes = surface.withColumn("kde_class", class_of(F.col("z"), lower, upper))
    return class_cr(classes, counts, missions).withColumns({"lower": F.lit(lower), "upper": F.lit(upper)})


def narrative(table: DataFrame, group: str) -> DataFrame:
    """One sentence per row of a strata or class table."""
    text = F.format_string(f"%s, {group} %d: %.1f %% of %d cells covered", F.col("mission"), F.col(group).cast("int"), 100 * F.col("cr"), F.col("ncells"))
    return table.withColumn("sentence", text)
