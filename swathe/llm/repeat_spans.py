"""Suffix-array removal of repeated byte strings.

Every byte is removed that lies in a string of LENGTH bytes which also starts earlier, in a
smaller doc_id or earlier in the same document. Strings are judged on the input.

A suffix array over the whole corpus would sort every position. Here positions are first dealt to
small buckets, as in a bucketed suffix sort: the window of LENGTH bytes that starts at a position
belongs to the smallest k-gram hash in it (its anchor), which is the same wherever the window
occurs. A run of neighbouring windows with one anchor is one row, named by the anchor's polynomial
hash and by 64 bits of a BLAKE2 digest of all bytes the run covers. The two are independent, so
rows of one name are equal but for a chance of 2**-64 for each two runs of one anchor.

1. Rows of one name are copies: all but the first are removed whole. Inside a task such copies
   are met before the shuffle, so a passage that every document holds costs a row per task.
2. Rows with one anchor and different names (the ends of a repeated passage) need a sort: the
   windows' suffixes are merge-sorted, two suffixes being compared at the end of their common
   extension, which binary search over prefix polynomial hashes finds. Neighbours that agree
   over LENGTH bytes are verified byte by byte.
3. An anchor that a sketch of fixed size calls hot would make a bucket too large for one task:
   its windows are dealt by a hash of all their bytes instead, each a bucket of its own, and named
   by the digest of these bytes.

Edge cases: null or empty texts have no bytes and nothing removed; texts shorter than LENGTH keep
everything. Rows with equal doc_id and text count as one document and all get its result; equal
doc_id with different texts is ordered by text; a null doc_id comes before all others. Other
columns are ignored, an empty input gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1
SKETCH_BITS = 20
BLOCK_BITS = 10
#: A bucket is hot from so many rows on, and from so many times the mean.
HOT_ROWS, HOT_FACTOR = 2048, 8
PIECE = 1 << 19
NO_ID = -(1 << 63)
U = np.uint64
ROW = "kind int, key long, name long, doc long, ver int, lo int, span long"


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64 bits of a BLAKE2 digest of each range of bytes and of its anchor's distance."""
    raw = memoryview(np.ascontiguousarray(data))
    blake = hashlib.blake2b
    out = b"".join([blake(raw[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(out, np.uint64) + off.astype(np.uint64) * K.PLACE[5]


def anchors(data: np.ndarray, offs: np.ndarray, strong: bool = True):
    """Runs of windows with a common anchor: arrays (text, lo, n, off, key, name), where ``lo`` is
    the first window's start in its text, ``n`` the number of windows and ``off`` the anchor's
    distance from ``lo``; then the prefix hashes and the runs' absolute starts. Names are digests if
    ``strong``, polynomial hashes otherwise (to count runs)."""
    pre = K.prefix(data)
    _, inv = K.powers(len(pre))
    n = len(data)
    out = []
    for a in range(0, max(n - LENGTH + 1, 0), PIECE):
        b = min(n, a + PIECE + LENGTH - 1)
        g = np.arange(a, b - GRAM + 1)
        h = K.mix((pre[g + GRAM] - pre[g]) * inv[g])
        low = (h & ~U((1 << 22) - 1)) | (g - a).astype(np.uint64)
        width = 1
        while width * 2 <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = SPAN - width
        if rest:
            low = np.minimum(low[:-rest], low[rest:])
        at = (low & U((1 << 22) - 1)).astype(np.int64) + a
        s = np.arange(a, a + len(at))
        text = np.searchsorted(offs, s, "right") - 1
        whole = s + LENGTH <= offs[text + 1]
        s, at, text = s[whole], at[whole], text[whole]
        if not len(s):
            continue
        new = np.ones(len(s), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        i = np.flatnonzero(new)
        count = np.diff(np.append(i, len(s)))
        start = s[i]
        key = h[at[i] - a]
        end = start + count + LENGTH - 1
        name = digests(data, start, end, at[i] - start) if strong else K.span_hash(pre, start, end)
        out.append((text[i], start - offs[text[i]], count, at[i] - start, key, name, start))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.view(np.uint64), z.view(np.uint64), pre, z
    t, lo, c, o, key, name, start = (np.concatenate(x) for x in zip(*out, strict=True))
    return t, lo, c, o, key, name, pre, start


def _runs(batch: pa.RecordBatch, strong: bool = True):
    """``anchors`` of each chunk of a batch, with the documents' keys and the chunk's bytes."""
    doc = batch.column("doc").to_numpy()
    ver = batch.column("ver").to_numpy()
    data, offs = K.strings(batch.column("text"))
    for lo, hi in K.chunks(offs, PIECE):
        part = data[offs[lo] : offs[hi]]
        yield doc[lo:hi], ver[lo:hi], part, anchors(part, offs[lo : hi + 1] - offs[lo], strong)


def sketched(key: np.ndarray) -> np.ndarray:
    """The sketch's bucket of each anchor. Anchors are the smallest of many hashes, so their own upper
    bits are mostly zero: they are hashed again, or a few buckets would hold all of them."""
    return (K.mix(key ^ K.PLACE[7]) >> U(64 - SKETCH_BITS)).astype(np.int64)


def hot_buckets(docs: DataFrame) -> bytes:
    """One byte for each of 2**SKETCH_BITS hash buckets of anchors: 1 if hot. Counts travel as
    blocks of bytes, as a row for each of so many buckets would fill the driver."""
    bits = min(BLOCK_BITS, SKETCH_BITS)

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, _, (_, _, _, _, key, name, _, _) in _runs(batch, strong=False):
                first = np.unique(K.mix(key ^ (name * U(5))), return_index=True)[1]
                total += np.bincount(sketched(key[first]), minlength=len(total))
        if total.any():
            parts = total.reshape(-1, 1 << bits)
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(parts)), pa.int32()), "counts": [zlib.compress(x.tobytes(), 1) for x in parts]})

    def merge(batches):
        sums: dict[int, np.ndarray] = {}  # 2**SKETCH_BITS numbers at most
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(counts), np.int64)
                sums[block] = sums[block] + x if block in sums else x
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "counts": [x.tobytes() for x in sums.values()]})

    parts = docs.mapInArrow(count, "block int, counts binary").repartition(64, "block").mapInArrow(merge, "block int, counts binary")
    total = np.zeros((1 << (SKETCH_BITS - bits), 1 << bits), np.int64)
    for row in parts.collect():  # 2**SKETCH_BITS numbers of 8 bytes
        total[row.block] = np.frombuffer(row.counts, np.int64)
    n = total.ravel()
    return (n > max(HOT_ROWS, HOT_FACTOR * n.sum() / len(n))).astype(np.uint8).tobytes()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256
    and ``kept``, the bytes that stay."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    repeated = ids.groupBy("doc").count().where("count > 1").limit(1)
    if repeated.isEmpty():
        ids = once = ids.select("doc", F.lit(0).alias("ver"), "text")
    else:
        ids = ids.select("doc", (F.dense_rank().over(Window.partitionBy("doc").orderBy("text")) - 1).alias("ver"), "text")
        once = ids.dropDuplicates(["doc", "ver"])
    shared = ids.sparkSession.sparkContext.broadcast(hot_buckets(once))

    def emit(batches):
        hot = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for doc, ver, data, (text, lo, n, off, key, name, pre, start) in _runs(batch):
                if not len(text):
                    continue
                span = (n << 8) | off
                is_hot = hot[sketched(key)] > 0
                if is_hot.any():  # one row for each window, named by all its bytes
                    i = np.repeat(np.flatnonzero(is_hot), n[is_hot])
                    j = np.arange(len(i)) - np.repeat(np.cumsum(n[is_hot]) - n[is_hot], n[is_hot])
                    s = start[i] + j
                    more = (text[i], lo[i] + j, np.full(len(i), 1 << 8), K.mix(K.span_hash(pre, s, s + LENGTH) + K.PLACE[4]), digests(data, s, s + LENGTH, s * 0))
                    text, lo, span, key, name = (np.concatenate([x[~is_hot], y]) for x, y in zip((text, lo, span, key, name), more, strict=True))
                rank = np.empty(len(doc), np.int64)
                rank[np.lexsort((ver, doc))] = np.arange(len(doc))
                order = np.lexsort((lo, rank[text], K.mix(key ^ (name * U(5)))))
                text, lo, span, key, name = (x[order] for x in (text, lo, span, key, name))
                again = np.zeros(len(key), bool)
                again[1:] = (key[1:] == key[:-1]) & (name[1:] == name[:-1])
                d, v = doc[text], ver[text]
                # copies inside this chunk are settled; neighbouring runs of a text become one row
                i = np.flatnonzero(again)
                i = i[np.lexsort((lo[i], text[i]))]
                t, a, b = text[i], lo[i], lo[i] + (span[i] >> 8)
                if len(i):
                    new = np.ones(len(i), bool)
                    new[1:] = (t[1:] != t[:-1]) | (a[1:] > b[:-1] + LENGTH - 1)
                    f = np.flatnonzero(new)
                    end = np.maximum.reduceat(b, f)
                    yield pa.RecordBatch.from_pydict(_row(1, K.signed(K.mix(doc[t[f]].view(np.uint64))), f * 0, doc[t[f]], ver[t[f]], a[f], (end - a[f]) << 8))
                k = ~again
                yield pa.RecordBatch.from_pydict(_row(0, K.signed(key[k]), K.signed(name[k]), d[k], v[k], lo[k], span[k]))

    def settle(batches):
        """Copies of a name are removed; the first rows of an anchor with several names go on."""
        held = None
        for batch in _then_none(batches):
            if batch is not None:
                new = {c: batch.column(c).to_numpy() for c in batch.schema.names}
                rows = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
                cut = int(np.searchsorted(rows["key"], rows["key"][-1]))
            elif held is None:
                return
            else:
                rows, cut = held, len(held["key"])
            if cut:
                r = {c: x[:cut] for c, x in rows.items()}
                done = r["kind"] == 1
                same = (r["key"][1:] == r["key"][:-1]) & ~done[1:] & ~done[:-1]
                copy = np.zeros(cut, bool)
                copy[1:] = same & (r["name"][1:] == r["name"][:-1])
                other = np.zeros(cut, bool)
                differs = same & (r["name"][1:] != r["name"][:-1])
                other[1:] = differs
                keys = np.unique(r["key"][other])
                several = np.isin(r["key"], keys) & ~done & ~copy
                for kind, which in ((1, done | copy), (2, several)):
                    if which.any():
                        yield pa.RecordBatch.from_pydict(_row(kind, *(r[c][which] for c in ("key", "name", "doc", "ver", "lo", "span"))))
            held = {c: x[cut:] for c, x in rows.items()}

    rows = once.mapInArrow(emit, ROW)
    seen = materialize(rows.repartition("key").sortWithinPartitions("key", "name", "doc", "ver", "lo").mapInArrow(settle, ROW), "seen")

    def cut_out(batches):
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            data, offs = K.strings(batch.column("text"))
            at = batch.column("runs")
            parts = at.flatten()
            owner = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
            lo, span = parts.field("lo").to_numpy(), parts.field("span").to_numpy()
            s = offs[owner] + lo
            e = s + (span >> 8) + LENGTH - 1
            raw = memoryview(np.ascontiguousarray(data))
            doc, ver = batch.column("doc").to_numpy()[owner], batch.column("ver").to_numpy()[owner]
            for i in range(0, len(owner), 4096):
                p = slice(i, i + 4096)
                found = pa.array([bytes(raw[x:y]) for x, y in zip(s[p].tolist(), e[p].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_pydict({"key": parts.field("key")[p], "doc": doc[p], "ver": ver[p], "lo": lo[p], "span": span[p], "bytes": found})

    def sort_buckets(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in _then_none(batches):
            if batch is not None:
                held.append(batch)
                size += batch.nbytes
                if size < 1 << 20:
                    continue
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("key").to_numpy()
            cut = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
            if cut:
                yield from _repeats(t.slice(0, cut))
            held = t.slice(cut).to_batches()
            size = 0 if cut else size

    ends = seen.where("kind = 2").groupBy("doc", "ver").agg(F.collect_list(F.struct("key", "lo", "span")).alias("runs"))
    found = (
        once.join(ends, ["doc", "ver"])
        .mapInArrow(cut_out, "key long, doc long, ver int, lo int, span long, bytes binary")
        .repartition("key")
        .sortWithinPartitions("key", "doc", "ver", "lo")
        .mapInArrow(sort_buckets, "doc long, ver int, lo int, size int")
    )
    gone = found.union(seen.where("kind = 1").selectExpr("doc", "ver", "lo", f"int((span >> 8) + {LENGTH - 1})"))
    gone = gone.groupBy("doc", "ver").agg(F.collect_list(F.struct("lo", "size")).alias("gone"))

    def apply(batches):
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            data, offs = K.strings(batch.column("text"))
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for i, gaps in enumerate(batch.column("gone")):
                text = data[offs[i] : offs[i + 1]]
                spans, kept = 0, text
                if gaps.is_valid and len(gaps.values):
                    lo = gaps.values.field("lo").to_numpy()
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, lo + gaps.values.field("size").to_numpy(), -1)
                    over = np.cumsum(edge[:-1]) > 0
                    spans = int(over[0]) + int((over[1:] & ~over[:-1]).sum())
                    kept = text[~over]
                raw = kept.tobytes()
                for c, x in zip(out, (len(text), len(text) - len(raw), spans, hashlib.sha256(raw).hexdigest(), raw), strict=True):
                    out[c].append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(pa.array(out[c], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["doc", *out]
            )

    result = ids.join(gone, ["doc", "ver"], "left").mapInArrow(apply, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    back = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    return result.select(back, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _row(kind: int, key, name, doc, ver, lo, span) -> dict:
    return {
        "kind": np.full(len(key), kind, np.int32),
        "key": key,
        "name": np.asarray(name, np.int64),
        "doc": doc,
        "ver": np.asarray(ver, np.int32),
        "lo": np.asarray(lo, np.int32),
        "span": np.asarray(span, np.int64),
    }


def _then_none(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def _repeats(t: pa.Table):
    """Suffix-sorts the windows of each bucket; yields what lies in a window met earlier."""
    data, offs = K.strings(t.column("bytes"))
    key = t.column("key").to_numpy()
    span = t.column("span").to_numpy().astype(np.int64)
    n, off = span >> 8, span & 255
    row = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    bucket = np.cumsum(np.append(0, key[1:] != key[:-1]))
    group = bucket[row] * 256 + (j - off[row] + 128)  # windows can only agree at one distance from the anchor
    order = np.argsort(group, kind="stable")  # by document and place inside a group
    group, row, j = group[order], row[order], j[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, len(group)))
    many = np.repeat(size > 1, size)
    group, row, j = group[many], row[many], j[many]
    if not len(group):
        return
    pos = offs[row] + j
    pre = K.prefix(data)
    order = merge_sort(pre, data, pos, group)
    p, g, row, j = pos[order], group[order], row[order], j[order]
    near = np.flatnonzero(g[1:] == g[:-1])
    equal = np.zeros(len(p), bool)
    equal[near + 1] = extension(pre, p[near], p[near + 1]) == LENGTH
    claim = np.flatnonzero(equal)
    for a in range(0, len(claim), 1 << 15):  # collision verification
        c = claim[a : a + (1 << 15)]
        at = np.arange(LENGTH)
        if not (data[p[c - 1][:, None] + at] == data[p[c][:, None] + at]).all():
            raise ArithmeticError("two byte strings share their polynomial hashes; choose another base")
    row, j = row[equal], j[equal]
    if len(row):
        rows, inverse = np.unique(row, return_inverse=True)
        lo = np.full(len(rows), 1 << 40)
        hi = np.zeros(len(rows), np.int64)
        np.minimum.at(lo, inverse, j)
        np.maximum.at(hi, inverse, j)
        # windows of one run overlap, so together they cover one range
        yield pa.RecordBatch.from_pydict(
            {
                "doc": t.column("doc").to_numpy()[rows],
                "ver": t.column("ver").to_numpy()[rows],
                "lo": (t.column("lo").to_numpy()[rows] + lo).astype(np.int32),
                "size": (hi - lo + LENGTH).astype(np.int32),
            }
        )


def extension(pre: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of the common extension of the strings at p and q, up to LENGTH: binary search
    over prefix polynomial hashes."""
    _, inv = K.powers(len(pre))
    lo = np.zeros(len(p), np.int64)
    hi = np.full(len(p), LENGTH)
    a, b, x, y = pre[p], pre[q], inv[p], inv[q]
    for _ in range(LENGTH.bit_length()):
        mid = (lo + hi + 1) >> 1
        same = (pre[p + mid] - a) * x == (pre[q + mid] - b) * y
        lo = np.where(same, mid, lo)
        hi = np.where(same, hi, np.maximum(mid - 1, lo))
    return lo


def merge_sort(pre: np.ndarray, data: np.ndarray, pos: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A stable order of the suffixes at ``pos`` inside each group (given contiguous): bottom-up
    merges of all groups at once, each place found by binary search in the neighbouring run."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, len(group)))
    order = np.arange(len(pos))
    width = 1
    while width < size.max():
        live = np.repeat(size > width, size)
        base = np.repeat(first, size)[live]
        length = np.repeat(size, size)[live]
        i = np.flatnonzero(live) - base
        left = i % (2 * width) < width
        block = i - i % (2 * width)
        run = np.where(left, block, block + width)
        a = np.where(left, np.minimum(block + width, length), block)
        b = np.where(left, np.minimum(block + 2 * width, length), block + width)
        lo, hi = a.copy(), b.copy()
        mine = pos[order[base + i]]
        for _ in range(width.bit_length()):
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            other = pos[order[base[open_] + mid]]
            own = mine[open_]
            ext = extension(pre, own, other)
            tie = ext == LENGTH
            e = np.minimum(ext, LENGTH - 1)
            less = np.where(tie, ~left[open_], data[other + e] < data[own + e])
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        place = base + block + (i - run) + (lo - a)
        moved = order.copy()
        moved[place] = order[base + i]
        order = moved
        width *= 2
    return order
