"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner products are made nearest neighbours: a vector gets one more component so that all
have the norm M, the largest norm in the table; a query gets 0 there. Gaussian (2-stable)
projections, cut into cells of equal width, give each vector a bucket in each table. A query
visits the buckets of a table in the order of their estimated success: the sum of the squared
distances from the query's projections to the bucket's cells. Candidates of all tables are merged
and ranked by exact inner products.

Projections and cells are fitted on a bounded sample (SAMPLE rows). How many buckets are visited is
fitted on SAMPLE_QUERIES of them, whose true neighbours in the whole table a scan finds: RECALL of
these must lie in visited buckets. Where neighbours are hardly nearer than other rows, that is a
large part of the buckets. A query goes on until its buckets hold at least k other rows.

Each table has at most CELLS**PROJECTIONS buckets, whatever the table's size; their sizes are
known to the driver. Rows are stored once for each table, in the order of their buckets and in
their own precision; of equal vectors only the k + 1 smallest vec_ids, as no query needs more.
They do not travel again: queries are broadcast in rounds of at most ROUND_BYTES, a few long tasks
read the rows and keep a running top k for each query, and each round's results are merged. So
what is on disk grows with the rows, not with rows times queries.

Similarities are computed in single precision; what may be among the k best by their error bound
is computed again in double precision.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do those whose dimension is not the most frequent one (the larger on a tie); rows that share
the query's vec_id count as its own; rows repeating a vec_id and a vector are found once.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize
from .vectors import packed

TABLES, PROJECTIONS, CELLS = 2, 5, 4
SAMPLE, SAMPLE_QUERIES = 4096, 128
RECALL = 0.96
BUCKETS = CELLS**PROJECTIONS
#: Rows that meet queries at once, queries that a row of the written ones holds, bytes of a round's queries.
BLOCK, QUERIES, ROUND_BYTES = 8192, 1024, 64 << 20
SEED = 7


class Index:
    """Projections, cell borders and the number of buckets to visit."""

    def __init__(self, sample: np.ndarray, top: float):
        rng = np.random.default_rng(SEED)
        self.top = top
        self.dim = sample.shape[1]
        self.axes = rng.standard_normal((TABLES, self.dim + 1, PROJECTIONS))
        self.axes /= np.linalg.norm(self.axes, axis=1, keepdims=True)
        spread = np.stack([self.lift(sample) @ a for a in self.axes])  # tables, rows, projections
        self.middle = np.median(spread, axis=1)
        # cells as wide as the standard deviation, around a shifted median; the outer ones are open
        self.width = np.maximum(spread.std(axis=1), 1e-12)
        self.shift = rng.uniform(-0.25, 0.25, (TABLES, PROJECTIONS))
        self.codes = np.array(list(product(range(CELLS), repeat=PROJECTIONS)))
        self.visits = 1.0

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top**2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest]) / self.top

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table."""
        up = self.lift(x)
        out = np.empty((len(x), TABLES), np.int32)
        for t in range(TABLES):
            cell = np.floor((up @ self.axes[t] - self.middle[t]) / self.width[t] + self.shift[t]) + CELLS // 2
            cell = np.clip(cell, 0, CELLS - 1).astype(np.int64)
            out[:, t] = cell @ (CELLS ** np.arange(PROJECTIONS)[::-1])
        return out

    def success(self, q: np.ndarray, t: int) -> np.ndarray:
        """For each query and bucket of a table the squared distance to the bucket: small is likely."""
        up = np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))])
        at = (up @ self.axes[t] - self.middle[t]) / self.width[t] + self.shift[t] + CELLS // 2
        cells = np.arange(CELLS)
        low = np.where(cells == 0, -np.inf, cells)
        high = np.where(cells == CELLS - 1, np.inf, cells + 1)
        gap = np.maximum(np.maximum(low - at[:, :, None], at[:, :, None] - high), 0) ** 2
        return sum(gap[:, i, self.codes[:, i]] for i in range(PROJECTIONS))

    def order(self, q: np.ndarray, t: int, sizes: np.ndarray) -> np.ndarray:
        """Rank of each bucket in each query's visit order; empty buckets come last."""
        s = self.success(q, t)
        s[:, sizes == 0] = np.inf
        rank = np.empty(s.shape, np.int32)
        np.put_along_axis(rank, np.argsort(s, axis=1, kind="stable"), np.arange(s.shape[1], dtype=np.int32)[None], 1)
        return rank

    def fit(self, q: np.ndarray, owner: np.ndarray, where: np.ndarray, sizes: np.ndarray) -> None:
        """The share of the occupied buckets to visit in each table, from queries ``q`` and the
        buckets ``where`` of their true neighbours."""
        best = np.full(len(owner), np.inf)
        for t in range(TABLES):
            rank = self.order(q, t, sizes[t])
            best = np.minimum(best, rank[owner, where[:, t]] / max(1, (sizes[t] > 0).sum()))
        # the worst queries matter as well as the mean: the quantile is taken over all their neighbours
        if len(best):
            self.visits = float(min(1.0, np.quantile(best, RECALL) + 0.02))

    def visited(self, q: np.ndarray, sizes: np.ndarray, k: int) -> list[np.ndarray]:
        """For each table, which buckets each query visits."""
        out = []
        for t in range(TABLES):
            rank = self.order(q, t, sizes[t])
            filled = int((sizes[t] > 0).sum())
            order = np.argsort(rank, axis=1)
            held = np.cumsum(sizes[t][order], axis=1)
            enough = (held <= k).sum(1) + 1  # k others and the query's own row
            out.append(rank < np.maximum(int(np.ceil(self.visits * filled)), enough)[:, None])
        return out


class Best:
    """The k nearest of the rows met so far, for each query."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, top: float, k: int):
        self.ids, self.q, self.k, self.top = ids, q, k, top
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        self.unit = (q / norm[:, None]).astype(np.float32)
        self.scale = norm * top
        self.slack = 1.2e-7 * (q.shape[1] + 16)  # of a product of vectors of at most unit length
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.zeros((len(ids), k), np.int64)
        self.note = np.zeros((len(ids), k), np.int32)

    def meet(self, which: np.ndarray, ids: np.ndarray, x: np.ndarray, note: np.ndarray, seen=None) -> None:
        """The queries ``which`` meet rows, all or those that ``seen(queries)`` marks."""
        unit = np.ascontiguousarray((x / self.top).astype(np.float32).T)
        by = np.argsort(ids, kind="stable")
        ordered = ids[by]
        for a in range(0, len(which), QUERIES):
            w = which[a : a + QUERIES]
            near = self.unit[w] @ unit
            lo, hi = (np.searchsorted(ordered, self.ids[w], side) for side in ("left", "right"))
            for i in np.flatnonzero(hi > lo):
                near[i, by[lo[i] : hi[i]]] = -np.inf  # the query's own rows
            bar = np.maximum(self.score[w, -1] / self.scale[w] - self.slack, -2).astype(np.float32)
            some = near >= bar[:, None]
            marks = None if seen is None else seen(w)
            if marks is not None:
                some &= marks
            many = np.flatnonzero(np.count_nonzero(some, axis=1) > 4 * self.k)
            if len(many):
                open_ = near[many] if marks is None else np.where(marks[many], near[many], np.float32(-np.inf))
                least = np.partition(open_, -self.k, axis=1)[:, -self.k] - np.float32(2 * self.slack)
                some[many] &= near[many] >= least[:, None]
            i, j = np.divmod(np.flatnonzero(some.ravel()), some.shape[1])
            for c in range(0, len(i), 1 << 15):
                r, o = w[i[c : c + (1 << 15)]], j[c : c + (1 << 15)]
                exact = (x[o].astype(np.float64) * self.q[r]).sum(1)  # the same sum for equal vectors, wherever they lie
                ok = exact >= self.score[r, -1]
                self.merge(r[ok], exact[ok], ids[o[ok]], note[o[ok]])

    def merge(self, r: np.ndarray, score: np.ndarray, ids: np.ndarray, note: np.ndarray) -> None:
        if not len(r):
            return
        u = np.unique(r)
        r = np.concatenate([np.repeat(u, self.k), r])
        score, ids, note = (np.concatenate([old[u].ravel(), new]) for old, new in ((self.score, score), (self.found, ids), (self.note, note)))
        order = np.lexsort((ids, -score, r))
        order = order[score[order] > -np.inf]
        r, score, ids, note = r[order], score[order], ids[order], note[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])
        r, score, ids, note = r[new], score[new], ids[new], note[new]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
        take = rank < self.k
        self.score[u] = -np.inf
        for old, value in ((self.score, score), (self.found, ids), (self.note, note)):
            old[r[take], rank[take]] = value[take]

    def rows(self):
        """(query's number, score, vec_id, note) of what was found, in parts."""
        for a in range(0, len(self.ids), 4096):
            i, j = np.nonzero(self.score[a : a + 4096] > -np.inf)
            if len(i):
                yield i + a, self.score[i + a, j], self.found[i + a, j], self.note[i + a, j]


def nearest(table: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` selects its k nearest."""
    spark = table.sparkSession
    kind = np.float32 if dict(table.dtypes)[embedding] == "array<float>" else np.float64
    rows = packed(table.withColumn("_q", F.coalesce(is_query, F.lit(False))), vec_id, embedding, "_q", kind=kind).where("v is not null and vec_id is not null")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm2").alias("m"), F.count_if("_q").alias("q")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not dims or not dims[0].q:
        return empty
    dim, top = dims[0].dim, float(np.sqrt(dims[0].m)) * (1 + 1e-9)
    rows = rows.where(F.col("dim") == dim).select("vec_id", "_q", "v")
    some = rows.select("v", F.md5(F.col("vec_id").cast("string")).alias("h"), "vec_id").orderBy("h", "vec_id", "v").limit(SAMPLE).collect()  # SAMPLE rows at most
    sample = np.frombuffer(b"".join(bytes(r.v) for r in some), kind).reshape(len(some), dim)
    index = Index(sample.astype(np.float64), top)
    tried, tried_ids = sample[:SAMPLE_QUERIES], np.array([r.vec_id for r in some[:SAMPLE_QUERIES]])
    first = spark.sparkContext.broadcast((index, tried, tried_ids))

    def survey(batches):
        """Rows in each bucket (n is not null), and the true neighbours of the sample's queries."""
        index, q, ids = first.value
        total = np.zeros((TABLES, BUCKETS), np.int64)
        best = Best(ids, q, index.top, k)
        for c in _stacked(batches, BLOCK, kind, dim):
            b = index.buckets(c["v"])
            for t in range(TABLES):
                total[t] += np.bincount(b[:, t], minlength=BUCKETS)
            best.meet(np.arange(len(ids)), c["vec_id"], c["v"], b @ BUCKETS ** np.arange(TABLES, dtype=np.int32))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at]), *(pa.nulls(len(at), t) for t in (pa.float64(), pa.int64(), pa.int32()))], names)
        for r, score, found, note in best.rows():
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.nulls(len(r), pa.int64()), pa.array(score), pa.array(found), pa.array(note)], names)

    names = ["at", "n", "score", "vec_id", "note"]
    seen = materialize(rows.select("vec_id", "v").mapInArrow(survey, "at int, n long, score double, vec_id long, note int"), "survey")
    sizes = np.zeros(TABLES * BUCKETS, np.int64)
    for r in seen.where("n is not null").groupBy("at").agg(F.sum("n").alias("n")).collect():  # TABLES * BUCKETS rows at most
        sizes[r["at"]] = r["n"]
    sizes = sizes.reshape(TABLES, BUCKETS)
    true = seen.where("n is null").withColumnRenamed("at", "query_id").distinct()
    true = true.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).collect()  # SAMPLE_QUERIES * k rows at most
    note = np.array([r.note for r in true], np.int64)
    index.fit(tried.astype(np.float64), np.array([r.query_id for r in true], np.int64), np.stack([note // BUCKETS**t % BUCKETS for t in range(TABLES)], axis=1), sizes)
    parts = np.maximum(1, -(-sizes // BLOCK))
    layout = spark.sparkContext.broadcast((index, parts))

    def stored(t: int) -> DataFrame:
        """All rows in the order of table ``t``'s buckets."""

        def place(batches):
            index, parts = layout.value
            for c in _stacked(batches, BLOCK, kind, dim):
                b = index.buckets(c["v"])[:, t]
                raw = np.ascontiguousarray(c["v"]).view(np.uint8)
                order = np.lexsort((c["vec_id"], _hash(raw)))
                order = order[_fresh(raw[order], c["vec_id"][order], k)[0]]
                part = (_hash(raw[order]) % parts[t, b[order]].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(b[order] + t * BUCKETS, pa.int32()), pa.array(part), pa.array(c["vec_id"][order]), _binary(raw[order])], ["bucket", "part", "vec_id", "v"])

        def thin(batches):
            held = None
            for c in _stacked(batches, 1, kind, dim):
                raw = np.ascontiguousarray(c["v"]).view(np.uint8)
                keep, held = _fresh(raw, c["vec_id"], k, held)
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(c["bucket"][keep]), pa.array(c["vec_id"][keep]), _binary(raw[keep])], ["bucket", "vec_id", "v"])

        placed = rows.select("vec_id", "v").mapInArrow(place, "bucket int, part int, vec_id long, v binary").repartition("bucket", "part")
        return materialize(placed.sortWithinPartitions("bucket", "v", "vec_id").mapInArrow(thin, "bucket int, vec_id long, v binary"), "placed")

    placed = [stored(t) for t in range(TABLES)]  # one after the other: one table's shuffle is on disk
    held = np.zeros(TABLES * BUCKETS, np.int64)
    for p in placed:
        for r in p.groupBy("bucket").count().collect():  # BUCKETS rows at most
            held[r.bucket] = r["count"]
    held = spark.sparkContext.broadcast(held.reshape(TABLES, BUCKETS))
    groups = max(1, -(-dims[0].q // QUERIES))

    def pack_queries(batches):
        """Blocks of queries, with a bit for each bucket that they visit; bits of one bucket are contiguous."""
        index, _ = layout.value
        for t in _groups(batches, "grp", QUERIES):
            v = _matrix(t.column("v"), kind, dim)
            bits = np.concatenate(index.visited(v.astype(np.float64), held.value, k), axis=1)
            yield pa.RecordBatch.from_pydict({"grp": pa.array([t["grp"][0].as_py()], pa.int32()), "ids": [t["vec_id"].to_numpy().tobytes()], "vecs": [v.tobytes()], "bits": [np.packbits(bits, axis=1).T.tobytes()]})

    asked = rows.where("_q").select("vec_id", "v").dropDuplicates().withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    asked = materialize(asked.repartition("grp").sortWithinPartitions("grp", "vec_id").mapInArrow(pack_queries, "grp int, ids binary, vecs binary, bits binary"), "queries")
    rounds = -(-dims[0].q * (dim * np.dtype(kind).itemsize + TABLES * BUCKETS // 8 + 8) // ROUND_BYTES)
    every = placed[0]
    for p in placed[1:]:
        every = every.union(p)
    # few tasks, as each returns up to k rows for each query
    every = every.coalesce(2 * spark.sparkContext.defaultParallelism)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    again = F.lag("vec_id").over(order).eqNullSafe(F.col("vec_id")) & F.lag("score").over(order).eqNullSafe(F.col("score"))

    def one_round(number: int) -> DataFrame:
        got = asked.where(F.col("grp") % rounds == number).select("ids", "vecs", "bits").collect()  # ROUND_BYTES, give or take a block
        asking = spark.sparkContext.broadcast([tuple(bytes(x) for x in r) for r in got])

        def search(batches):
            ids = np.frombuffer(b"".join(x[0] for x in asking.value), np.int64)
            q = np.frombuffer(b"".join(x[1] for x in asking.value), kind).reshape(len(ids), dim)
            bits = np.concatenate([np.frombuffer(x[2], np.uint8).reshape(TABLES * BUCKETS // 8, -1) for x in asking.value], axis=1) if len(ids) else None
            best = Best(ids, q, top, k)
            sees = lambda b, w=slice(None): (bits[b >> 3, w] >> (7 - (b & 7))) & 1 > 0
            for c in _stacked(batches, BLOCK, kind, dim) if len(ids) else ():
                by = np.argsort(c["bucket"], kind="stable")
                at, counts = np.unique(c["bucket"], return_counts=True)
                cut = np.append(0, np.cumsum(counts))
                a = 0
                while a < len(at):  # neighbouring buckets together until they are a quarter of a block
                    b = a + 1
                    while b < len(at) and cut[b] - cut[a] < BLOCK // 4:
                        b += 1
                    p = by[cut[a] : cut[b]]
                    any_ = sees(at[a])
                    for other in at[a + 1 : b]:
                        any_ = any_ | sees(other)
                    which = np.flatnonzero(any_)
                    mask = (lambda w, a=a, b=b: np.repeat(np.stack([sees(x, w) for x in at[a:b]], axis=1), counts[a:b], axis=1)) if b > a + 1 else None
                    best.meet(which, c["vec_id"][p], c["v"][p], np.zeros(len(p), np.int32), mask)
                    a = b
            for r, score, found, _ in best.rows():
                yield pa.RecordBatch.from_pydict({"query_id": ids[r], "vec_id": found, "score": score})

        found = every.mapInArrow(search, "query_id long, vec_id long, score double").withColumn("_again", again).where("not _again")
        out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if rounds > 1:
            out = materialize(out, "nearest")
            asking.destroy()
        return out

    out = one_round(0)
    for number in range(1, rounds):
        out = out.union(one_round(number))
    return out


def _hash(raw: np.ndarray) -> np.ndarray:
    """64 bits for each row of bytes."""
    wide = raw.view(np.uint32).astype(np.uint64)
    return K.mix((wide * (K.powers(wide.shape[1])[0][: wide.shape[1]])).sum(1, dtype=np.uint64))


def _fresh(raw: np.ndarray, ids: np.ndarray, k: int, held: tuple | None = None) -> tuple[np.ndarray, tuple | None]:
    """Of neighbouring equal rows, ordered by id, the first k + 1 different ids; ``held`` carries
    the last row over to the next call."""
    n = len(ids)
    if not n:
        return np.zeros(0, bool), held
    same = np.zeros(n, bool)
    same[1:] = (raw[1:] == raw[:-1]).all(1)
    before = np.empty(n, np.int64)
    before[1:] = ids[:-1]
    had = 0
    if held is not None and held[0] == raw[0].tobytes():
        same[0], before[0], had = True, held[1], held[2]
    new = ~(same & (ids == before)) if same[0] else np.append(True, ~(same[1:] & (ids[1:] == ids[:-1])))
    c = np.cumsum(new)
    start = np.flatnonzero(~same)
    base = np.zeros(n, np.int64)
    base[start] = c[start] - 1
    base = np.maximum.accumulate(base)
    lead = start[0] if len(start) else n
    rank = c - base
    rank[:lead] += had
    return new & (rank <= k + 1), (raw[-1].tobytes(), int(ids[-1]), int(rank[-1]))


def _binary(raw: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow column."""
    n, width = raw.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def _matrix(col, kind: type, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    data, offs = K.strings(col)
    return np.frombuffer(data[offs[0] : offs[-1]].tobytes(), kind).reshape(len(col), dim)


def _stacked(batches, least: int, kind: type, dim: int):
    """The batches' columns as arrays, ``least`` rows or more at a time."""
    held, n = [], 0
    for batch in _then_none(batches):
        if batch is not None:
            held.append(batch)
            n += batch.num_rows
            if n < least:
                continue
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        yield {c: _matrix(t.column(c), kind, dim) if c == "v" else t.column(c).to_numpy() for c in t.column_names}
        held, n = [], 0


def _groups(batches, key: str, most: int):
    """Tables of equal key from sorted batches, of at most ``most`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in _then_none(batches):
        if batch is not None:
            held.append(batch)
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        values = t.column(key).to_numpy()
        cut = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        ends = np.append(cut[1:], len(values))
        held = []
        for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
            if b == len(values) and batch is not None and b - a < most:
                held = t.slice(a).to_batches()
                break
            for i in range(a, b, most):
                yield t.slice(i, min(most, b - i)).combine_chunks()
        if batch is None:
            return


def _then_none(batches):
    yield from (b for b in batches if b.num_rows)
    yield None
