"""Pixel features, standardising, principal components and clustering."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import lab

EPS = float(np.finfo(float).eps)


def pixel_features(pixels: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(row, col, f): CIELAB of r, g, b and further columns as one array."""
    L, a, b = lab(F.col("r"), F.col("g"), F.col("b"))
    return pixels.select("row", "col", F.array(L, a, b, *[F.col(c).cast("double") for c in extra]).alias("f"))


def moments(features: DataFrame) -> DataFrame:
    """(j, mu, sigma) per component; the sample deviation, at least the machine epsilon."""
    flat = features.select(F.posexplode("f").alias("j", "v"))
    return flat.groupBy("j").agg(F.avg("v").alias("mu"), F.greatest(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), F.lit(EPS)).alias("sigma"))


@dataclass(frozen=True)
class Projector:
    """Means and deviations of the components, and principal axes if wanted (rows)."""

    mu: tuple[float, ...]
    sigma: tuple[float, ...]
    axes: tuple[tuple[float, ...], ...] | None = None

    def column(self, f: Column | str = "f") -> Column:
        f = F.col(f) if isinstance(f, str) else f
        numbers = lambda v: F.lit([float(x) for x in v])
        z = F.zip_with(F.zip_with(f, numbers(self.mu), lambda x, m: x - m), numbers(self.sigma), lambda x, s: x / s)
        if self.axes is None:
            return z
        axes = F.array(*[numbers(axis) for axis in self.axes])
        return F.transform(axes, lambda axis: F.aggregate(F.zip_with(z, axis, lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v))


def covariance(features: DataFrame, dim: int) -> np.ndarray:
    """Mean products of the components: each task sums its own dim * dim products."""

    def products(batches):
        total, n = np.zeros((dim, dim)), 0
        for batch in batches:
            col = batch.column(0)
            x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"k": np.arange(dim * dim + 1, dtype=np.int32), "v": np.append(total.ravel(), n)})

    rows = features.where(F.size("f") == dim).select("f").mapInArrow(products, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # dim * dim numbers
    out = np.zeros(dim * dim + 1)
    for r in rows:
        out[r.k] = r.v
    return (out[:-1] / max(out[-1], 1)).reshape(dim, dim)


def fit_projector(features: DataFrame, dim: int, pca: bool = False, keep: float = 0.95, most: int | None = None) -> Projector:
    m = sorted(moments(features).collect(), key=lambda r: r.j)  # one row per component
    plain = Projector(tuple(r.mu for r in m), tuple(r.sigma for r in m))
    if not pca:
        return plain
    values, vectors = np.linalg.eigh(covariance(features.select(plain.column().alias("f")), dim))
    order = np.argsort(-values)
    share = np.cumsum(values[order]) / values.sum()
    k = min(int(np.searchsorted(share, keep) + 1), most or dim, dim)
    return Projector(plain.mu, plain.sigma, tuple(tuple(float(x) for x in vectors[:, i]) for i in order[:k]))


def explained(features: DataFrame, dim: int) -> list[tuple[int, float, float]]:
    """(component, share of variance, cumulative share) of standardised features."""
    p = fit_projector(features, dim)
    values = np.sort(np.linalg.eigvalsh(covariance(features.select(p.column().alias("f")), dim)))[::-1]
    share = values / values.sum()
    return [(i + 1, float(s), float(c)) for i, (s, c) in enumerate(zip(share, np.cumsum(share), strict=True))]


def choose_sample(features: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """A deterministic sample without replacement: the n smallest digests of seed and id."""
    return features.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def distance(a: str, b: str, metric: str = "sqeuclidean") -> Column:
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    if metric == "sqeuclidean":
        return d
    if metric == "euclidean":
        return F.sqrt(d)
    raise ValueError(f"unknown metric: {metric}")


def sample_pairs(sample: DataFrame, key: str = "id", metric: str = "euclidean") -> DataFrame:
    """All pairs of a bounded sample with their distances (the sample is at most a few thousand)."""
    a, b = (sample.select(F.col(key).alias(x), F.col("f").alias(f"f{x}"), F.col("label").alias(f"l{x}")) for x in "ij")
    return a.crossJoin(F.broadcast(b)).where("i <> j").withColumn("d", distance("fi", "fj", metric)).drop("fi", "fj")


def silhouette(pairs: DataFrame) -> DataFrame:
    """Mean silhouette from labelled pairs (i, j, li, lj, d); singletons count 0."""
    means = pairs.groupBy("i", "li", "lj").agg(F.avg("d").alias("m"))
    own = F.max(F.when(F.col("li") == F.col("lj"), F.col("m")))
    other = F.min(F.when(F.col("li") != F.col("lj"), F.col("m")))
    rows = means.groupBy("i").agg(own.alias("a"), other.alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return rows.agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("silhouette"))


def dunn(pairs: DataFrame) -> DataFrame:
    """Least distance between clusters over the largest inside one; null where every cluster has
    zero diameter, 0 with one cluster."""
    inter, intra = F.min(F.when(F.col("li") != F.col("lj"), F.col("d"))), F.max(F.when(F.col("li") == F.col("lj"), F.col("d")))
    return pairs.agg(F.when(inter.isNull(), 0.0).otherwise(F.try_divide(inter, intra)).alias("dunn"))


def centroids(rows: DataFrame) -> DataFrame:
    """(label, n, c): mean of each cluster's features (rows: id, label, f)."""
    flat = rows.select("label", F.posexplode("f").alias("j", "v")).groupBy("label", "j").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    arr = F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"])  # one entry per component
    return flat.groupBy("label").agg(F.max("n").alias("n"), arr.alias("c"))


def davies_bouldin(rows: DataFrame) -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij; null with fewer than two clusters."""
    c = centroids(rows)
    s = rows.join(F.broadcast(c), "label").groupBy("label").agg(F.avg(distance("f", "c", "euclidean")).alias("s"))
    c = c.join(s, "label")
    a, b = (c.select(F.col("label").alias(f"l{x}"), F.col("c").alias(f"c{x}"), F.col("s").alias(f"s{x}")) for x in "ij")
    pair = a.crossJoin(F.broadcast(b)).where("li <> lj").withColumn("r", F.try_divide(F.col("si") + F.col("sj"), distance("ci", "cj", "euclidean")))
    return pair.groupBy("li").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(rows: DataFrame) -> DataFrame:
    c = centroids(rows)
    whole = rows.select(F.posexplode("f").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m"))
    g = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("g"))
    between = c.crossJoin(F.broadcast(g)).agg(F.sum(F.col("n") * distance("c", "g")).alias("ssb"), F.count("*").alias("k"), F.sum("n").alias("n"))
    within = rows.join(F.broadcast(c), "label").agg(F.sum(distance("f", "c")).alias("ssw"))
    return between.crossJoin(within).select(F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k"))).alias("calinski_harabasz"))


def pam(d: np.ndarray, k: int, seed: int = 42, rounds: int = 50) -> np.ndarray:
    """k-medoids of a bounded sample's distance matrix: seeded greedy build, then swaps of a
    cluster's medoid for its best member until nothing moves."""
    n = len(d)
    if not 1 <= k <= n:
        raise ValueError("k must lie between 1 and the sample's size")
    rng = np.random.default_rng(seed)
    medoids = [int(d.sum(1).argmin())]
    while len(medoids) < k:
        near = d[:, medoids].min(1)
        gain = np.maximum(near[None] - d, 0).sum(1)
        gain[medoids] = -1
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        medoids.append(int(best[rng.integers(len(best))]))
    m = np.array(medoids)
    for _ in range(rounds):
        label = d[:, m].argmin(1)
        new = m.copy()
        for c in range(k):
            members = np.flatnonzero(label == c)
            if len(members):
                new[c] = members[d[np.ix_(members, members)].sum(1).argmin()]
        if (new == m).all():
            break
        m = new
    return m


def assign_medoids(features: DataFrame, medoids: Sequence[Sequence[float]]) -> DataFrame:
    """``label`` (from 1): the nearest medoid by squared distance, the first on a tie."""
    table = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.array(*[F.lit(float(v)) for v in m]).alias("m")) for i, m in enumerate(medoids)])
    sq = lambda s: F.aggregate(F.zip_with("f", s["m"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v)
    return features.withColumn("label", F.array_min(F.transform(table, lambda s: F.struct(sq(s).alias("d"), s["i"].alias("i"))))["i"])


def kmedoids(features: DataFrame, k: int, nsample: int = 2000, seed: int = 42, metric: str = "sqeuclidean", key: str = "id") -> tuple[DataFrame, list[list[float]]]:
    """Fit on a bounded sample on the driver, label every row where it is."""
    rows = choose_sample(features, nsample, seed, key).select("f").collect()  # nsample rows at most
    x = np.array([r.f for r in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(2) if len(x) < 500 else np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0)
    medoids = x[pam(np.sqrt(d) if metric == "euclidean" else d, k, seed)].tolist()
    return assign_medoids(features, medoids), medoids


def indices(sample: DataFrame, key: str = "id") -> DataFrame:
    """One row: the four quality indices of a labelled bounded sample."""
    pairs = sample_pairs(sample, key)
    return silhouette(pairs).crossJoin(dunn(pairs)).crossJoin(davies_bouldin(sample)).crossJoin(calinski_harabasz(sample))


def sweep_k(features: DataFrame, ks: Sequence[int] = range(2, 13), nsample: int = 2000, seed: int = 42, key: str = "id") -> DataFrame:
    """(k, silhouette, dunn, davies_bouldin, calinski_harabasz) for each k up to the sample's size.
    The sample is fitted and scored once per k; k is a handful."""
    sample = choose_sample(features, nsample, seed, key).persist()
    size = sample.count()
    out = None
    for k in ks:
        if k > size:
            continue
        labelled, _ = kmedoids(sample, k, nsample, seed, key=key)
        row = indices(labelled, key).withColumn("k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no k fits the sample")
    return out


def votes(sweep: DataFrame) -> DataFrame:
    """``votes``: each index nominates its best finite k, the lowest on a tie."""
    ok = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c))
    best = [F.max_by("k", F.struct(ok(c), -F.col("k"))) for c in ("silhouette", "dunn", "calinski_harabasz")]
    low = F.max_by("k", F.struct(-ok("davies_bouldin"), -F.col("k")))
    named = sweep.agg(F.array(*best, low).alias("_v"))
    return sweep.crossJoin(F.broadcast(named)).withColumn("votes", F.size(F.filter("_v", lambda x: x == F.col("k")))).drop("_v")


def choose_k(sweep: DataFrame, strategy: str = "vote") -> int:
    """The chosen k; ties go to the lowest."""
    order = {"vote": F.desc("votes"), "mode": F.desc("votes"), "silhouette": F.desc_nulls_last("silhouette"), "dunn": F.desc_nulls_last("dunn"), "db": F.asc_nulls_last("davies_bouldin"), "cal": F.desc_nulls_last("calinski_harabasz")}
    if strategy not in order:
        raise ValueError(f"unknown strategy: {strategy}")
    return votes(sweep).orderBy(order[strategy], "k").first().k


def labels_to_mask(labels: DataFrame, tree_labels: Sequence[int] = (1,)) -> DataFrame:
    if not tree_labels:
        raise ValueError("name the tree labels")
    return labels.withColumn("mask", F.col("label").isin(*tree_labels))


def cluster_summary(rows: DataFrame, overlap: str | None = None) -> DataFrame:
    """Per cluster: size, share, mean L, a, b, -a, and the share of rows where ``overlap`` holds."""
    means = [F.avg(F.col("f")[i]).alias(n) for i, n in enumerate(("mean_L", "mean_a", "mean_b"))]
    more = [F.avg(F.col(overlap).cast("double")).alias("overlap_share")] if overlap else []
    out = rows.groupBy("label").agg(F.count("*").alias("n"), *means, *more)
    return out.withColumns({"frac": F.col("n") / F.sum("n").over(Window.partitionBy()), "minus_a": -F.col("mean_a")})  # one row per cluster
