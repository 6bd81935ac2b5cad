"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct k-word shingles (64-bit hashes). Two documents link when
their sets' Jaccard similarity reaches the threshold. The plan:

1. A frequency sketch of fixed size over all shingles gives one global order, rare ones first;
   prefix filtering then needs only the first ``n - ceil(t * n) + 1`` shingles of a set.
2. Documents with equal sets are one class (128 bits of hashes name a set), classes with the same
   prefix and size form one group, and only groups travel with their tokens. A token that no
   other group of a fitting size has is dropped in a streaming pass. Tokens the sketch calls
   hot are dealt by group instead of by token, so no task receives a whole hot token.
3. The classes of a group are linked first, each with a few pivots of its group. What is then in one
   component is one part of the group; mostly a group has a single part.
4. Parts that share a token are paired, pairs are filtered by size and position, and only then
   expanded: to one member each, to all members of one side, at last to all of both, and verified
   on whole sets. Each step takes only tokens whose parts lie in several components, there only
   parts outside the largest one, and all steps but the last pair them with a few pivots of
   their token (linear). A token with no more parts than pivots, of one class each, is done then; the
   next step does not place it again. Tokens that are hot in a join are dealt to several places.
5. Whole sets travel only for pairs that a bitmap filter leaves. A set's bitmap has the parity of its
   shingles at two to four places for each shingle; two bitmaps differ at no more places than the
   sets have shingles apart, so no link is lost, and most other pairs go at a 32nd of the bytes.

Edge cases: null or empty texts and texts without words have an empty set and link with nothing;
with fewer than k words the whole sequence is the one shingle. Rows that repeat a doc_id count as
one node for linking, whatever their texts, and are all returned; rows with a null doc_id link
with nothing and get a null component. Additional columns of the input are ignored, an empty input
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import SALTS, components, hot_ones, materialize, split_by_ids

SKETCH_BITS = 22
BLOCK_BITS = 12
HOT_FACTOR = 64
#: Parts of each token that all its other parts are compared with in a linear step.
PIVOTS, MORE_PIVOTS = 8, 64
LONG_RUN = 256
#: Rows of a token to a place in a join of parts.
DEALT = 4096
U = np.uint64


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offs = K.strings(batch.column("text"))
    for lo, hi in K.chunks(offs):
        yield lo, K.shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)


def frequency_classes(docs: DataFrame, k: int) -> bytes:
    """2**SKETCH_BITS bytes: for each hash bucket twice the binary logarithm of how many
    documents have a shingle there. The size is fixed whatever the corpus holds."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for _, sets in _sets(batch, k):
                if sets:
                    np.add.at(total, (np.concatenate(sets) >> U(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
        if total.any():
            parts = total.reshape(-1, 1 << BLOCK_BITS)
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(parts)), pa.int32()), "counts": [zlib.compress(x.tobytes(), 1) for x in parts]})

    def merge(batches):
        now, total = None, None
        done: list[tuple[int, bytes]] = []

        def close():
            if now is not None:
                done.append((now, np.where(total > 0, 1 + 2 * np.log2(np.maximum(total, 1)), 0).astype(np.uint8).tobytes()))

        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now:
                    close()
                    now, total = block, np.zeros(1 << BLOCK_BITS, np.uint64)
                total += np.frombuffer(zlib.decompress(counts), np.uint32)
        close()
        if done:
            yield pa.RecordBatch.from_pydict({"block": pa.array([x for x, _ in done], pa.int32()), "classes": [y for _, y in done]})

    parts = docs.select("text").mapInArrow(count, "block int, counts binary").repartition(64, "block").sortWithinPartitions("block").mapInArrow(merge, "block int, classes binary")
    out = np.zeros((1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for row in parts.collect():  # 2**SKETCH_BITS bytes at most
        out[row.block] = np.frombuffer(row.classes, np.uint8)
    return out.tobytes()


def signature(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set, as two signed integers."""
    size = np.array([len(s)], np.uint64)
    one = K.mix(K.mix(s + U(0x51ED270B)).sum(dtype=np.uint64) + size * K.PLACE[6])
    two = K.mix(K.mix(s * K.PLACE[5] + U(0x2545F491)).sum(dtype=np.uint64) + size * K.PLACE[4])
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """For each value of the low bits, whether an odd number of the set's hashes have it."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """At how many places two bitmaps differ: at most the size of the sets' symmetric difference. The
    longer one is folded, as its upper half has the places of the lower half by one more bit."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.unpackbits(x ^ y).sum())


def fitting(token: np.ndarray, n: np.ndarray, pos: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which rows have another row of their token whose size and position still allow a link. Rows
    are sorted by token; in runs of over LONG_RUN rows every row stays."""
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    size = np.diff(np.append(first, len(token)))
    long = np.repeat(size > LONG_RUN, size)
    length = np.where(long | np.repeat(size == 1, size), 0, np.repeat(size, size))
    i = np.repeat(np.arange(len(token)), length)
    j = np.repeat(np.repeat(first, size), length) + np.arange(len(i)) - np.repeat(np.cumsum(length) - length, length)
    a, b, p, q = n[i].astype(np.int64), n[j].astype(np.int64), pos[i], pos[j]
    ok = (i != j) & (den * np.minimum(a, b) >= num * np.maximum(a, b)) & ((num + den) * np.minimum(a - p, b - q) >= num * (a + b))
    return long | (np.bincount(i[ok], minlength=len(token)) > 0)


def prefix_of(s: np.ndarray, ranks: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens and frequency classes of a set's prefix in the global order (rare first), and the name
    of its group: the sets with this prefix and size."""
    cls = ranks[(s >> U(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    order = np.sort((cls << U(56)) | (s >> U(8)))[: len(s) - -(-num * len(s) // den) + 1]
    group = K.mix(K.mix(order).sum(dtype=np.uint64, keepdims=True) + np.array([len(s)], np.uint64) * K.PLACE[3])
    # the class is left out of the token: 56 hash bits are enough
    return K.signed(order & U((1 << 56) - 1)), (order >> U(56)).astype(np.int64), int(group.view(np.int64)[0])


def jaccard_components(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) per row of ``docs(doc_id, text)``; documents
    link when den * |intersection| >= num * |union|."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = frequency_classes(docs, k)
    table = np.frombuffer(classes, np.uint8)
    mean = float(table.mean())
    hot = int(mean + 2 * np.log2(HOT_FACTOR))
    shared = spark.sparkContext.broadcast(classes)

    def signatures(batches):
        ranks = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            s1, s2, grp, n, maps = [], [], [], [], []
            for _, sets in _sets(batch, k):
                for s in sets:
                    n.append(len(s))
                    maps.append(bitmap(s) if len(s) else None)
                    one, two = signature(s) if len(s) else (None, None)
                    s1.append(one)
                    s2.append(two)
                    grp.append(prefix_of(s, ranks, num, den)[2] if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (s1, s2, grp, n)), pa.array(maps, pa.binary())], ["doc_id", "s1", "s2", "grp", "n", "bits"])

    def prefixes(batches):
        ranks = np.frombuffer(shared.value, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            for _, sets in _sets(batch, k):
                tok, grp, size, pos, deal = [], [], [], [], []
                for s in sets:
                    if not len(s):
                        continue
                    t, c, group = prefix_of(s, ranks, num, den)
                    if group in seen:
                        continue
                    if len(seen) >= 1 << 20:  # bounded: a group forgotten is only met again
                        seen.clear()
                    seen.add(group)
                    keep = c > 1  # a bucket that one document alone has matches nothing
                    tok.append(t[keep])
                    pos.append(np.flatnonzero(keep))
                    grp.append(np.full(keep.sum(), group))
                    size.append(np.full(keep.sum(), len(s)))
                    deal.append(np.where(c[keep] >= hot, group & 0x3FFF | 1, 0))
                if tok:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "token": np.concatenate(tok),
                            "deal": np.concatenate(deal).astype(np.int32),
                            "grp": np.concatenate(grp),
                            "n": np.concatenate(size).astype(np.int32),
                            "pos": np.concatenate(pos).astype(np.int32),
                        }
                    )

    def met_twice(batches):
        """Drops repeated rows, and rows whose token no other group of a fitting size has. Rows
        come sorted by token and group."""
        held = overlong = None
        for batch in _with_end(batches):
            if batch is None:
                rows = held
                if rows is None:
                    return
                cut = len(rows["token"])
            else:
                new = {c: batch.column(c).to_numpy() for c in ("token", "deal", "grp", "n", "pos")}
                rows = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
                t = rows["token"]
                cut = int(np.searchsorted(t, t[-1])) if len(t) else 0
                if cut == 0 and len(t) > 200_000:  # a run longer than the sketch foresaw: all of it stays
                    cut, overlong = len(t), t[-1]
            if cut:
                t, d, g, n, pos = (rows[c][:cut] for c in ("token", "deal", "grp", "n", "pos"))
                first = np.ones(cut, bool)
                first[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
                t, d, g, n, pos = (x[first] for x in (t, d, g, n, pos))
                keep = (d > 0) | (t == overlong if overlong is not None else False) | fitting(t, n, pos, num, den)
                if keep.any():
                    yield pa.RecordBatch.from_pydict({"token": t[keep], "grp": g[keep], "n": n[keep], "pos": pos[keep]})
            held = {c: v[cut:] for c, v in rows.items()}

    def _with_end(batches):
        yield from (b for b in batches if b.num_rows)
        yield None

    named = materialize(docs.mapInArrow(signatures, "doc_id long, s1 long, s2 long, grp long, n long, bits binary"), "named")
    held = named.where("s1 is not null and doc_id is not null")
    where = held.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.min("grp").alias("grp"), F.min("n").cast("int").alias("size"), F.count("*").alias("n"))
    where = materialize(where.withColumn("cls", F.monotonically_increasing_id()), "classes")
    members = where.select("grp", "cls", "node", "size")
    rows = docs.where("doc_id is not null").select("text").mapInArrow(prefixes, "token long, deal int, grp long, n int, pos int")
    grouped = rows.repartition("token", "deal").sortWithinPartitions("token", "grp").mapInArrow(met_twice, "token long, grp long, n int, pos int")
    tokens = materialize(grouped, "tokens")
    several = materialize(members.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), "several").select("grp")
    # the parts of a group meet under the group's own name
    inside = members.join(several, "grp").select(F.col("grp").alias("token"), "grp", F.col("size").alias("n"), F.lit(0).alias("pos")).distinct()
    tokens = tokens.union(inside)

    fits = (
        f"{den} * least(na, nb) >= {num} * greatest(na, nb) and "
        f"({num} + {den}) * least(na - pa, nb - pb) >= {num} * (na + nb)"
    )
    side = lambda x, df: df.select("token", "salt", *[F.col(c).alias(c + x) for c in ("grp", "comp", "some", "major")], F.col("n").alias("n" + x), F.col("pos").alias("p" + x))
    comp = done = None

    def placed() -> DataFrame:
        """All classes with the components that the links found so far give."""
        if comp is None:
            return members.withColumn("comp", F.col("node"))
        return members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def link(pairs: DataFrame) -> None:
        """Verifies pairs (a, b) of classes that no step before has verified, and joins components."""
        nonlocal comp, done
        found = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        found = materialize(found if done is None else found.join(done, ["a", "b"], "left_anti"), "pairs")
        done = found if done is None else done.union(found)
        links = verify(found, where, docs, held, num, den, k)
        if comp is not None and links.isEmpty():
            return
        comp = components(links if comp is None else comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(links))

    if several.isEmpty():
        comp = spark.createDataFrame([], "node long, comp long")
    else:
        slot = F.pmod(F.xxhash64("cls"), F.lit(PIVOTS))
        own = members.join(several, "grp")
        pivots = own.groupBy("grp", slot.alias("slot")).agg(F.min("cls").alias("b")).select("grp", "b")
        link(pivots.join(own.select("grp", F.col("cls").alias("a")), "grp").select("a", "b"))

    every, budget = tokens, 0
    for step, (slots, whole) in enumerate(((PIVOTS, ""), (MORE_PIVOTS, "a"), (None, "ab"))):
        now = materialize(placed(), "placed")
        parts = now.groupBy("grp", "comp").agg(F.min("cls").alias("some"), F.count("*").alias("size"))
        # a token that has come to lie in one component stays so: only the last step's tokens are looked at
        spread = materialize(every.select("token", "grp", "n", "pos").distinct().join(parts, "grp"), "parts")
        tops = spread.groupBy("token", "comp").agg(F.count("*").alias("count"), F.sum("size").alias("size")).groupBy("token")
        tops = tops.agg(F.max_by("comp", F.struct("size", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("count").alias("rows"), F.sum("size").alias("classes")).where("comps > 1")
        every = materialize(spread.join(tops, "token").withColumn("major", F.col("comp") == F.col("top")).drop("top", "comps"), "spread")
        minor = every.where("not major")
        work = every.agg(F.sum("size").alias("all"), F.sum(F.when(~F.col("major"), F.col("size").cast("double") * F.col("classes"))).alias("whole")).first()
        if not work.whole:
            break
        budget = budget or PIVOTS * work.all
        if work.whole <= budget:  # no dearer than all tokens with pivots: compare all that is left
            slots, whole = None, "ab"
        if slots:
            # where there are no more parts than pivots, each is a pivot
            slot = F.when(F.col("rows") <= slots, F.col("some")).otherwise(F.pmod(F.xxhash64("some", F.lit(step)), F.lit(slots)))
            few = every.groupBy("token", slot.alias("slot")).agg(F.min(F.struct("grp", "comp", "some", "n", "pos", "major", "rows")).alias("p")).select("token", "p.*")
            many = minor
        else:
            few, many = minor, every
        salts = F.least(F.lit(SALTS), F.col("rows") / DEALT + 1).cast("int")
        many = many.withColumn("salt", F.pmod(F.xxhash64("grp", "comp"), salts).cast("int"))
        few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        cross = side("a", many).join(side("b", few), ["token", "salt"]).where("compa <> compb")
        if not slots:  # a pair of two minor parts comes once
            cross = cross.where("majora or struct(grpa, compa) < struct(grpb, compb)")
        met = cross.where(fits).select("grpa", "compa", "somea", "grpb", "compb", "someb").distinct()
        for x in "ab":
            if x in whole:
                met = met.drop("some" + x).join(now.select(F.col("grp").alias("grp" + x), F.col("comp").alias("comp" + x), F.col("cls").alias("some" + x)), ["grp" + x, "comp" + x])
        link(met.select(F.col("somea").alias("a"), F.col("someb").alias("b")))
        if not slots:
            break
        # tokens with so few parts, of one class each, have had all their pairs verified
        every = every.where((F.col("rows") > slots) | (F.col("classes") > F.col("rows")))

    labels = where.select("s1", "s2", "n", "node").join(comp, "node", "left").select("s1", "s2", "n", F.coalesce("comp", "node").alias("comp"))
    hot = hot_ones(labels, named.count()).select("s1", "s2", F.col("comp").alias("known"))
    dealt = named.join(hot, ["s1", "s2"], "left")
    rest = dealt.where("known is null").drop("known").join(labels.drop("n"), ["s1", "s2"], "left")
    out = dealt.where("known is not null").select("doc_id", "n", F.col("known").alias("comp")).union(rest.select("doc_id", "n", "comp"))
    out = out.withColumn("comp", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")))
    if not held.groupBy("doc_id").count().where("count > 1").limit(1).isEmpty():  # the texts of one doc_id are one node
        out = materialize(out, "labelled")
        nodes = out.where("doc_id is not null")
        again = components(nodes.select(F.col("comp").alias("a"), F.col("doc_id").alias("b")).distinct())
        out = out.join(again.select(F.col("node").alias("comp"), F.col("comp").alias("least")), "comp", "left").withColumn("comp", F.coalesce("least", "comp"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def verify(pairs: DataFrame, where: DataFrame, docs: DataFrame, named: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """The links (a, b) between the nodes of those pairs of classes whose whole sets reach the threshold."""

    def near(batches):
        for batch in batches:
            n, maps = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()).tolist(), zip(batch.column("ma"), batch.column("mb"), strict=True)
            differ = [apart(*(np.frombuffer(x.as_buffer(), np.uint8) for x in pair)) for pair in maps]
            yield batch.select(["a", "b"]).filter(pa.array([(den + num) * d <= (den - num) * size for d, size in zip(differ, n, strict=True)], pa.bool_()))

    def sets(batches):
        for batch in batches:
            out, s1, s2 = [], [], []
            for _, found in _sets(batch, k):
                for s in found:
                    one, two = signature(s) if len(s) else (0, 0)
                    out.append(s.tobytes())
                    s1.append(one)
                    s2.append(two)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(out, pa.binary())], ["node", "s1", "s2", "m"])

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum()) if len(q) else 0
                keep.append(both > 0 and den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("nodea"), batch.column("nodeb")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def joined(pairs: DataFrame, rows, tag: str) -> DataFrame:
        """The pairs with what ``rows(ids)`` has for both classes: node, n where it is there, m."""
        # a pair's lesser class is mostly a pivot: each side takes only what stands there
        roles = pairs.select(F.col("a").alias("cls"), F.lit(True).alias("first")).union(pairs.select("b", F.lit(False)))
        roles = roles.groupBy("cls").agg(F.max("first").alias("first"), F.max(~F.col("first")).alias("second"))
        wanted = materialize(roles.join(where.select("cls", "node", "s1", "s2"), "cls"), "wanted")
        # (s1, s2) names a class, so repeated rows of a node are met where the join has put them
        found = rows(wanted.select(F.col("node").alias("doc_id"))).join(wanted.hint("merge"), ["node", "s1", "s2"]).dropDuplicates(["node", "s1", "s2"])
        store = materialize(found.drop("s1", "s2"), tag)
        what = [c for c in store.columns if c not in ("cls", "first", "second")]
        left, right = (store.where(role).select(F.col("cls").alias(x), *[F.col(c).alias(c + x) for c in what]) for role, x in (("first", "a"), ("second", "b")))
        return pairs.join(right, "b").join(left, "a")

    none = pairs.sparkSession.createDataFrame([], "a long, b long")
    if pairs.isEmpty():
        return none
    maps = joined(pairs, lambda ids: split_by_ids(named, ids)[0].select(F.col("doc_id").alias("node"), "s1", "s2", "n", F.col("bits").alias("m")), "bitmaps")
    pairs = materialize(maps.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(near, "a long, b long"), "near")
    if pairs.isEmpty():
        return none
    whole = joined(pairs, lambda ids: split_by_ids(docs, ids)[0].mapInArrow(sets, "node long, s1 long, s2 long, m binary"), "sets")
    return materialize(whole.select("nodea", "nodeb", "ma", "mb").mapInArrow(compare, "a long, b long"), "links")
