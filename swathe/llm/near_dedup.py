"""Embedding near-dedup on a robust-pruned flat graph.

Vectors of equal label link when their cosine reaches the threshold. Exact copies are collapsed
first. The others are dealt to overlapping shards: each vector goes to its OVERLAP nearest cluster
centroids (fitted on a bounded sample). A cluster of a label with more than BLOCK vectors is cut
into parts, and every two parts meet in a shard, so no task holds more than about two parts and no
pair of a cluster is lost.

Each shard builds a graph whose neighbour lists are robustly pruned (a neighbour is dropped if a
nearer one is closer to it by the factor ALPHA); the lists of a vector from all shards are united,
whole. Each shard is then searched on the united lists, for all its vectors at once: greedily from
the shard's medoid until no neighbour is nearer, then expanding through everything inside
1 + 1 / ALPHA times the range. On a list that was pruned without a limit this bound loses nothing:
from any vertex an edge leads ALPHA times nearer to each target, so a path from the query to a
target within the range stays inside it. Similarities are computed, in double precision, for the
vertices that a search visits and no others, and a link is a visited pair that reaches the threshold.

Recall is audited twice. In each shard some of its vectors are compared with all of it; after a miss
the shard is searched again with twice the bound, and after another it is scanned whole. Over the
whole table QUERIES vectors (a stated query set, smallest digests first) are compared with every
vector of their label; as long as less than RECALL of their links was found, the overlap is
doubled, in the end to all clusters, where every pair of a label meets. ``report`` is given these figures.

Links are counted inside shards, each pair in one shard only; components come from one row per
vector and shard. So a group of n near copies costs n rows, not n * n.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors
with a null label, link with nothing; so do vectors of different dimension; rows that repeat a
vec_id count as one vector (the smallest in byte order that takes part), and all get its result.
A null vec_id gives a null component and links with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize
from .vectors import matrix, packed

THRESHOLD = 0.98
SAMPLE = 16384
MOST_CENTROIDS = 1024
#: Vectors of the largest label per centroid: with the overlap a shard has about three times as many.
CLUSTER = 256
BLOCK = 1280
OVERLAP = 4
DEGREE, CANDIDATES, ALPHA = 24, 64, 1.2
AUDIT, QUERIES, RECALL = 64, 1024, 0.99
#: Pairs that are multiplied at once, and the share of a shard from which on whole rows are cheaper.
CHUNK, DENSE = 1 << 16, 16
SEED = 11


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids_of(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on the sample."""
    rng = np.random.default_rng(SEED)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def robust_prune(s: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Neighbour lists (-1: none) from similarities: the nearest candidate stays and removes those
    that are closer to it, by the factor alpha, than to the vector itself."""
    n = len(s)
    m = min(candidates, n - 1)
    if m <= 0:
        return np.full((n, 1), -1)
    own = s.copy()
    own[np.arange(n), np.arange(n)] = -np.inf
    near = np.argpartition(-own, m - 1, axis=1)[:, :m]
    order = np.argsort(-np.take_along_axis(own, near, 1), axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    far = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(s, near, 1), 0))
    alive = np.ones((n, m), bool)
    out = np.full((n, min(degree, m)), -1)
    rows = np.arange(n)
    for j in range(out.shape[1]):
        pick = alive.argmax(1)
        some = alive[rows, pick]
        if not some.any():
            break
        p = near[rows, pick]
        out[some, j] = p[some]
        alive[rows, pick] = False
        between = np.sqrt(np.maximum(2 - 2 * s[p[:, None], near], 0))
        alive &= ~(some[:, None] & (alpha * between <= far) & (far > 0))
    return out


def products(x: np.ndarray, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (q, p); a vector in many of the pairs gets its row at once."""
    out = np.empty(len(q))
    n = len(x)
    wide = np.bincount(q, minlength=n) > n // DENSE
    many = np.flatnonzero(wide)
    order = np.argsort(q, kind="stable")
    at = np.searchsorted(q[order], np.arange(n + 1))
    for i in range(0, len(many), 256):
        block = many[i : i + 256]
        rows = x[block] @ x.T
        for row, v in zip(rows, block, strict=True):
            mine = order[at[v] : at[v + 1]]
            out[mine] = row[p[mine]]
    rest = np.flatnonzero(~wide[q])
    for i in range(0, len(rest), CHUNK):
        some = rest[i : i + CHUNK]
        out[some] = np.einsum("ij,ij->i", x[q[some]], x[p[some]])
    return out


def range_search(x: np.ndarray, first: np.ndarray, heads: np.ndarray, threshold: float, factor: float) -> tuple[np.ndarray, int]:
    """For every unit vector which others its search finds in range, and how many pairs were visited.
    The neighbours of vertex v are ``heads[first[v]:first[v + 1]]``; expansion goes through
    everything within ``factor`` times the range."""
    n = len(x)
    inside = 1 - (2 - 2 * threshold) * factor * factor / 2
    seen, hit, near = (np.zeros((n, n), bool) for _ in range(3))

    def visit(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        value = products(x, q, p)
        seen[q, p] = True
        hit[q, p] = value >= threshold
        near[q, p] = value >= inside
        return value

    def fan(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = first[v + 1] - first[v]
        at = np.arange(count.sum()) + np.repeat(first[v] - (np.cumsum(count) - count), count)
        q, p = np.repeat(q, count), heads[at]
        fresh = ~seen[q, p]
        return q[fresh], p[fresh]

    rows = np.arange(n)
    now = np.full(n, int((x @ x.mean(0)).argmax()))  # the medoid
    best = visit(rows, now)
    live = rows
    while len(live):
        q, p = fan(live, now[live])
        value = visit(q, p)
        order = np.lexsort((value, q))
        last = order[np.append(q[order][1:] != q[order][:-1], True)] if len(q) else order
        last = last[value[last] > best[q[last]]]
        live = q[last]
        now[live], best[live] = p[last], value[last]
    # a search that ended elsewhere is entered at the query's own vertex
    away = rows[~seen[rows, rows]]
    visit(away, away)
    near[rows, rows] = True
    gone = np.zeros((n, n), bool)
    dense = None
    while True:
        front = near & ~gone
        gone |= front
        live = np.flatnonzero(front.any(1))
        if not len(live):
            break
        for i in range(0, len(live), 64):
            block = live[i : i + 64]
            q, v = np.nonzero(front[block])
            if (first[v + 1] - first[v]).sum() <= len(block) * n // DENSE:
                q, p = fan(block[q], v)
                pair = np.unique(q * n + p)
                q, p = pair // n, pair % n
            else:
                if dense is None:
                    dense = np.zeros((n, n), np.float32)
                    dense[np.repeat(rows, np.diff(first)), heads] = 1
                q, p = np.nonzero((front[block].astype(np.float32) @ dense > 0) & ~seen[block])
                q = block[q]
            visit(q, p)
    visited = int(seen.sum())
    hit |= hit.T
    hit[rows, rows] = False
    return hit, visited


def near_components(table: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", report: dict | None = None) -> DataFrame:
    """One row per row of the table: vec_id, n_links, component_id, kept. ``report``, if given, takes the
    audit: recall of the queries' links, overlap, shards, how many were scanned, share of pairs visited."""
    spark = table.sparkSession
    rows = packed(table.select(vec_id, embedding, F.col(label).cast("string").alias("label")), vec_id, embedding, "label")
    rows = materialize(rows, "vectors")
    part = rows.where("v is not null and label is not null and vec_id is not null").select("vec_id", F.concat_ws("|", F.col("dim").cast("string"), "label").alias("label"), "v")
    if not part.groupBy("vec_id").count().where("count > 1").limit(1).isEmpty():
        part = part.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("x")).select("vec_id", "x.label", "x.v")
    part = part.withColumn("name", F.md5("v"))
    classes = materialize(part.groupBy("label", "name").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("v").alias("v")), "classes")
    back = part.select("vec_id", "label", "name").join(classes.select("label", "name", "rep", "size"), ["label", "name"]).select("vec_id", "rep", "size")

    labels = classes.groupBy("label").count().agg(F.max("count").alias("most")).first().most or 0
    dims = [r.d for r in classes.groupBy((F.length("v") / 8).cast("int").alias("d")).count().orderBy(F.desc("count"), "d").limit(64).collect()]
    centres = {}
    for d in dims:
        some = classes.where(F.length("v") == 8 * d).select("v", F.md5(F.col("rep").cast("string")).alias("h")).orderBy("h").limit(SAMPLE).collect()  # SAMPLE rows at most
        x = unit(np.frombuffer(b"".join(bytes(r.v) for r in some)).reshape(len(some), d))
        centres[d] = centroids_of(x, max(1, min(MOST_CENTROIDS, -(-labels // CLUSTER))))
    shared = spark.sparkContext.broadcast(centres)  # at most 64 sets of MOST_CENTROIDS centroids
    truth = _audit_truth(classes, threshold)
    overlap, most = OVERLAP, max((len(c) for c in centres.values()), default=1)
    while True:
        found = _shard_links(classes, shared, overlap, threshold)
        links = found.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
        seen = truth.join(links, "rep", "left").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("links", F.lit(0)))).alias("hits")).first()
        recall = seen.hits / seen.n if seen.n else 1.0
        if recall >= RECALL or overlap >= most:
            break
        overlap *= 2
    if report is not None:
        r = found.where("rep is null").agg(F.count("*").alias("shards"), F.sum("scanned").alias("scanned"), F.sum("visited").alias("visited"), F.sum("pairs").alias("pairs")).first()
        report.update(recall=recall, audited_links=seen.n or 0, overlap=overlap, shards=r.shards, scanned=r.scanned or 0, visited=(r.visited or 0) / max(r.pairs or 0, 1))
    comp = components(found.where("rep is not null").select(F.col("rep").alias("a"), F.col("comp").alias("b")))
    result = back.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    result = result.select("vec_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("comp", "rep").alias("component_id"))
    out = rows.select("vec_id").join(result, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _audit_truth(classes: DataFrame, threshold: float) -> DataFrame:
    """(rep, n): the links of QUERIES vectors to all others of their label, by brute force."""
    some = classes.orderBy(F.md5(F.col("rep").cast("string")), "rep").limit(QUERIES).select("label", "rep", "v").collect()  # QUERIES rows at most
    by: dict[str, tuple[list[int], list[np.ndarray]]] = {}
    for r in some:
        reps, vecs = by.setdefault(r.label, ([], []))
        reps.append(r.rep)
        vecs.append(np.frombuffer(bytes(r.v)))
    asked = classes.sparkSession.sparkContext.broadcast({k: (np.array(reps), unit(np.array(vecs))) for k, (reps, vecs) in by.items()})

    def count(batches):
        for batch in batches:
            names = np.array(batch.column("label").to_pylist(), dtype=object)
            for name in set(names.tolist()) & asked.value.keys():
                at = pa.array(np.flatnonzero(names == name))
                rep, size = (batch.column(c).take(at).to_numpy() for c in ("rep", "size"))
                reps, y = asked.value[name]
                linked = (y @ unit(matrix(batch.column("v").take(at))).T >= threshold) & (reps[:, None] != rep)
                yield pa.RecordBatch.from_pydict({"rep": reps, "n": (linked @ size).astype(np.int64)})

    counted = classes.select("label", "rep", "size", "v").mapInArrow(count, "rep long, n long")
    return materialize(counted.groupBy("rep").agg(F.sum("n").alias("n")), "audit")


def _shard_links(classes: DataFrame, shared, overlap: int, threshold: float) -> DataFrame:
    """(rep, links, comp) for each linked vector and shard, and a row with a null rep for each shard:
    whether it was scanned, how many pairs its search visited and how many it has."""

    def place(batches):
        for batch in batches:
            near: list[list[int]] = []
            for v in batch.column("v"):
                x = np.frombuffer(v.as_buffer(), np.float64)
                c = shared.value.get(len(x))
                # dimensions beyond the 64 most frequent have one cluster
                near.append([0] if c is None else sorted(np.argsort(-(c @ x), kind="stable")[:overlap].tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], [*batch.schema.names, "clusters"])

    placed = materialize(classes.select("label", "rep", "size", "v").mapInArrow(place, "label string, rep long, size long, v binary, clusters array<int>"), "placed")
    spots = placed.select("label", "rep", "size", "v", "clusters", F.explode("clusters").alias("cluster"))
    parts = materialize(spots.groupBy("label", "cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "parts")
    spots = spots.join(parts, ["label", "cluster"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # every two parts meet once; a cluster of one part is a shard of its own
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part")))
    shards = spots.withColumn("other", F.explode(others)).withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("other")
    key = ["label", "cluster", "lo", "hi"]
    shards = materialize(shards.select(*key, "part", "parts", "rep", "size", "clusters", "v").repartition(*key).sortWithinPartitions(*key, "rep"), "shards")

    def build(batches):
        for t in _shards(batches, key):
            x = unit(matrix(t["v"]))
            rep = t["rep"].to_numpy()
            adjacency = robust_prune(x @ x.T)
            yield pa.RecordBatch.from_arrays(
                [t["rep"].combine_chunks() if isinstance(t["rep"], pa.ChunkedArray) else t["rep"], pa.array([rep[a[a >= 0]].tolist() for a in adjacency], pa.list_(pa.int64()))], ["rep", "list"]
            )

    lists = shards.mapInArrow(build, "rep long, list array<bigint>").groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("list"))).alias("list"))
    united = shards.join(lists, "rep").repartition(*key).sortWithinPartitions(*key, "rep")

    def search(batches):
        for t in _shards(batches, key):
            n = t.num_rows
            x = unit(matrix(t["v"]))
            rep, size, part = (t[c].to_numpy() for c in ("rep", "size", "part"))
            lists = t["list"].combine_chunks() if isinstance(t["list"], pa.ChunkedArray) else t["list"]
            tail = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
            asked = lists.flatten().to_numpy()
            head = np.minimum(np.searchsorted(rep, asked), n - 1)
            tail, head = tail[rep[head] == asked], head[rep[head] == asked]
            # links go both ways, or a vector that is nobody's neighbour would never be met
            pair = np.unique(np.concatenate([tail * n + head, head * n + tail]))
            first, heads = np.searchsorted(pair, np.arange(n + 1) * n), pair % n
            probe = np.random.default_rng(int(rep[0]) & 0xFFFF).permutation(n)[:AUDIT]
            truth = x[probe] @ x.T >= threshold
            truth[np.arange(len(probe)), probe] = False
            visited, scanned = 0, 0
            for factor in (1 + 1 / ALPHA, 2 + 2 / ALPHA):
                hit, v = range_search(x, first, heads, threshold, factor)
                visited += v
                if not (truth & ~hit[probe]).any():
                    break
            else:
                hit = x @ x.T >= threshold
                hit[np.arange(n), np.arange(n)] = False
                visited, scanned = visited + n * n, 1
            yield pa.RecordBatch.from_pydict({"rep": [None], "links": [0], "comp": [0], "scanned": [scanned], "visited": [visited], "pairs": [n * n]}, schema=schema)
            i, j = np.nonzero(hit)
            keep = i < j
            i, j = i[keep], j[keep]
            # a pair belongs to the smallest cluster that both have, and there to one shard
            own = int(t["cluster"][0].as_py())
            cl = np.full((n, overlap), -1)
            for r, c in enumerate(t["clusters"].to_pylist()):
                cl[r, : len(c)] = c
            cl[cl >= own] = -1
            earlier = np.zeros(len(i), bool)
            for u in range(overlap):
                one = cl[i, u]
                earlier |= (one >= 0) & (cl[j] == one[:, None]).any(1)
            lo, hi, parts = (int(t[c][0].as_py()) for c in ("lo", "hi", "parts"))
            within = part[i] == part[j]
            # a part's own pairs belong to its shard with the next part (the last part's to that before)
            home = np.where(part[i] < parts - 1, part[i], part[i] - 1)
            mine = ~earlier & (~within | (parts == 1) | (home == lo) & (np.maximum(part[i], home + 1) == hi))
            i, j = i[mine], j[mine]
            if not len(i):
                continue
            links = np.bincount(i, weights=size[j], minlength=n) + np.bincount(j, weights=size[i], minlength=n)
            comp = np.arange(n)
            while True:
                low = comp.copy()
                np.minimum.at(low, i, comp[j])
                np.minimum.at(low, j, comp[i])
                low = low[low]
                if (low == comp).all():
                    break
                comp = low
            some = np.flatnonzero(links > 0)
            none = np.zeros(len(some), np.int64)
            yield pa.RecordBatch.from_pydict({"rep": rep[some], "links": links[some].astype(np.int64), "comp": rep[comp[some]], "scanned": none, "visited": none, "pairs": none}, schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in ("rep", "links", "comp", "scanned", "visited", "pairs")])
    return materialize(united.mapInArrow(search, ", ".join(f"{c} long" for c in schema.names)), "found")


def _shards(batches, key: list[str]):
    """Tables of one shard each, from sorted batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        n = batch.num_rows
        cols = [batch.column(c).to_pylist() for c in key]
        names = list(zip(*cols, strict=True))
        a = 0
        for b in range(1, n + 1):
            if b == n or names[b] != names[a]:
                if now is not None and names[a] != now and held:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                now = names[a]
                held.append(batch.slice(a, b - a))
                a = b
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
