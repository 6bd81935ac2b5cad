"""Line dedup by pairwise alignment.

Overlapping documents are found through shared lines that single a passage out, aligned with a
patience diff (a longest common subsequence where no line is unique on both sides), and the aligned
common blocks are deleted from the later document (the one with the larger doc_id).

Blank lines count for nothing; of the others a *sign* is each shortest run of two lines and more
with MIN_BYTES bytes (from each line on, and back from it), each line of PASSAGE bytes, and the
line of a document that has no other. One short line alone is no sign, whoever holds it: licence
lines and the like stay. Every document that holds a sign is aligned with the first that does, so a
group of n copies costs n pairs, and the result depends neither on a group's size nor on the
corpus around it. A sign that at most RARE documents hold pairs all of them, which gives
alignments with nearer versions, not other results.

A common block is a run of neighbouring lines that both documents hold, at least two lines with
MIN_BYTES bytes, or one line of PASSAGE bytes, or a document's only line. An alignment holds blocks
that come in the same order; what it leaves of the later document is aligned again with the
whole earlier one, MOVES times, and blocks left even then are found by the signs that both have. So
a line goes exactly if it lies in a block that an earlier document has somewhere; blank lines go
where both lines around them go in one block.

Edge cases: null and empty texts have one empty line and never match; rows with a null doc_id pass
unchanged; rows with equal doc_id are not compared with each other, and lose what any row of that
doc_id loses only where they have the same text. Other columns pass unchanged.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import SALTS, hot_ones, materialize, split_by_ids

RARE = 8
MIN_BYTES = 20
#: Alignments of a pair, each of what the one before has left, before signs settle the rest.
MOVES = 8
#: Bytes of a line that is a passage, not boilerplate, however many documents hold it.
PASSAGE = 100
#: Bits of an alignment's matrix held at once.
MATRIX = 1 << 28
U = np.uint64


def lines_of(data: np.ndarray, offs: np.ndarray):
    """Starts and ends of the lines of each text (split at \\n) and each text's first line index.
    A text has one line more than it has line ends."""
    nl = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], nl + 1]))
    ends = np.sort(np.concatenate([nl, offs[1:]]))
    text = np.searchsorted(nl, offs)
    return starts, ends, text + np.arange(len(offs))


def line_hashes(data: np.ndarray, offs: np.ndarray):
    starts, ends, first = lines_of(data, offs)
    solid = np.concatenate([[0], np.cumsum(~K.SPACE[data])])
    h = K.span_hash(K.prefix(data), starts, ends)
    h[solid[starts] == solid[ends]] = 0  # blank lines
    return starts, ends, first, h


def _rows(a: list[int], b: list[int]):
    """For each prefix of ``a``, as a bit vector, where the longest common subsequence with the
    prefixes of ``b`` grows (zero bits). Bit-parallel: a step costs len(b) / 64 word operations."""
    where: dict[int, int] = {}
    parts: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        parts.setdefault(x, []).append(j)
    for x, js in parts.items():
        bits = np.zeros(js[-1] + 1, np.uint8)
        bits[js] = 1
        where[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of ``a`` and every prefix of ``b``."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate([[0], np.cumsum(bits == 0)])


def longest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places. Ranges whose bit matrix would exceed
    MATRIX bits are halved first (Hirschberg), so memory stays bounded and the result is exact."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 > 1 and (a1 - a0) * (b1 - b0) > MATRIX:
            mid = (a0 + a1) // 2
            both = _lengths(a[a0:mid], b[b0:b1]) + _lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
            cut = b0 + int(both.argmax())
            todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
            continue
        rows = [(1 << (b1 - b0)) - 1, *_rows(a[a0:a1], b[b0:b1])]
        i, j = a1 - a0, b1 - b0
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a0 + i, b0 + j))
    out.sort()
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, length) of two line sequences, by patience diff:
    lines unique on both sides, their longest increasing chain, and the same between its links;
    where there is no such line, a longest common subsequence. Blocks grow to both sides over equal
    lines; blank lines (0) match only so."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict[int, list[int]] = {}
        for i in range(a0, a1):
            if a[i]:
                once.setdefault(a[i], [0, 0, 0, 0])[0] += 1
                once[a[i]][1] = i
        for j in range(b0, b1):
            if b[j] in once:
                once[b[j]][2] += 1
                once[b[j]][3] = j
        pairs = [(x[1], x[3]) for x in once.values() if x[0] == x[2] == 1]
        pairs.sort()
        tails: list[int] = []
        at: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(pairs):
            k = bisect_left(tails, j)
            back.append(at[k - 1] if k else -1)
            if k == len(tails):
                tails.append(j)
                at.append(n)
            else:
                tails[k], at[k] = j, n
        chain = []
        n = at[-1] if at else -1
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        chain.reverse()
        if not chain:
            ia = [i for i in range(a0, a1) if a[i] in once and once[a[i]][2]]
            jb = [j for j in range(b0, b1) if b[j] in once]
            chain = [(ia[i], jb[j]) for i, j in longest([a[i] for i in ia], [b[j] for j in jb])]
            for n in range(len(chain) - 2, -1, -1):  # links move towards the next one, so that blocks hold together
                (i, j), (x, y) = chain[n : n + 2]
                if y == j + 1 and x > i + 1 and a[x - 1] == b[j]:
                    chain[n] = (x - 1, j)
                elif x == i + 1 and y > j + 1 and b[y - 1] == a[i]:
                    chain[n] = (i, y - 1)
        i0, j0 = a0, b0
        for i, j in [*chain, (a1, b1)]:
            if chain and (i > i0 or j > j0):
                todo.append((i0, i, j0, j))
            if (i, j) != (a1, b1):
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    out.sort()
    blocks: list[tuple[int, int, int]] = []
    for i, j in out:
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def solid_lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and sizes of the lines that are not blank, and each text's first one."""
    starts, ends, first, h = line_hashes(data, offs)
    solid = h != 0
    return h[solid], (ends - starts)[solid], np.concatenate([[0], np.cumsum(solid)])[first]


def signs(h: np.ndarray, size: np.ndarray, first: np.ndarray, min_bytes: int = MIN_BYTES, passage: int = PASSAGE):
    """The signs of texts: (text, first line, last line, hash), lines counted over all texts."""
    n = len(h)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64)
    power, inv = K.powers(n + 1)
    pre = np.concatenate([[U(0)], np.cumsum(h * power[:n])])
    total = np.concatenate([[0], np.cumsum(size)])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    k = np.arange(n)
    far = np.maximum(k + 1, np.searchsorted(total, total[k] + min_bytes) - 1)
    back = np.minimum(k - 1, np.searchsorted(total, total[k + 1] - min_bytes, "right") - 1)
    ahead, behind, long = far < first[text + 1], back >= first[text], size >= passage
    only = (np.diff(first)[text] == 1) & (size >= min_bytes)
    a = np.concatenate([k[ahead], back[behind], k[long], k[only]])
    b = np.concatenate([far[ahead], k[behind], k[long], k[only]])
    name = K.mix((pre[b + 1] - pre[a]) * inv[a] + (b - a).astype(np.uint64) * K.PLACE[2])
    name[len(name) - only.sum() :] = K.mix(h[only] * K.PLACE[4])
    return text[a], a, b, name


def common_lines(a: np.ndarray, b: np.ndarray, size: np.ndarray, min_bytes: int = MIN_BYTES, passage: int = PASSAGE) -> list[int]:
    """What leaves the later document ``b`` of two line sequences without blanks: 2 k for line k,
    2 k + 1 for the blank lines between lines k and k + 1."""
    n = len(b)
    gone = np.zeros(2 * n, bool)
    alone = len(a) == n == 1
    la, lb = a.tolist(), b.tolist()

    def take(j: int, count: int) -> None:
        if count > 1 and size[j : j + count].sum() >= min_bytes:
            gone[2 * j : 2 * (j + count) - 1] = True
        elif count == 1 and (size[j] >= passage or alone and size[j] >= min_bytes):
            gone[2 * j] = True

    if la == lb:
        take(0, n)
        return np.flatnonzero(gone).tolist()
    for _, j, count in patience(la, lb):
        take(j, count)
    known = np.isin(b, a)
    for _ in range(MOVES):
        left = known & ~gone[::2]
        if not left.any():
            return np.flatnonzero(gone).tolist()
        # what is left, with a neighbour on each side; -1 parts the pieces, no line of a has it
        near = left.copy()
        near[1:] |= left[:-1]
        near[:-1] |= left[1:]
        at = np.flatnonzero(near)
        part = np.append(True, np.diff(at) > 1)
        line = np.insert(at, np.flatnonzero(part), -1)
        before = int(gone.sum())
        for _, j, count in patience(la, [lb[x] if x >= 0 else -1 for x in line.tolist()]):
            take(int(line[j]), count)
        if int(gone.sum()) == before:
            break
    if (known & ~gone[::2]).any():
        mine = signs(b, size, np.array([0, n]), min_bytes, passage)
        sizes = dict(zip(lb, size.tolist(), strict=True))  # lines that b lacks are in no sign of b
        other = signs(a, np.array([sizes.get(x, min_bytes) for x in la], np.int64), np.array([0, len(a)]), min_bytes, passage)[3]
        hit = np.isin(mine[3], other)
        for x, y in zip(mine[1][hit].tolist(), mine[2][hit].tolist(), strict=True):
            take(x, y - x + 1)
    return np.flatnonzero(gone).tolist()


def version(h: np.ndarray) -> int:
    """A name of a text's lines."""
    return int(K.mix(h * K.PLACE[3] + np.arange(len(h), dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))


def overlapping(docs: DataFrame, rare: int = RARE, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, DataFrame]:
    """Pairs (early, late) of documents to align, and the documents with a doc_id."""

    def of(batches):
        for batch in batches:
            data, offs = K.strings(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for lo, hi in K.chunks(offs):
                d, _, _, x = signs(*solid_lines(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), min_bytes)
                f = np.unique(K.mix(x ^ d.astype(np.uint64) * K.PLACE[2]), return_index=True)[1]
                yield pa.RecordBatch.from_pydict({"sign": K.signed(x[f]), "doc": ids[lo:hi][d[f]]})

    known = docs.where("doc_id is not null").select("doc_id", "text")
    rows = materialize(known.mapInArrow(of, "sign long, doc long"), "signs")
    held = materialize(rows.groupBy("sign").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).where("first < last").drop("last"), "held")
    hot = hot_ones(held, held.agg(F.sum("n")).first()[0] or 0).select("sign", F.col("first").alias("hub"))
    dealt = rows.join(hot, "sign", "left")
    met = dealt.where("hub is null").select("sign", "doc").join(held, "sign")
    star = met.select(F.col("first").alias("early"), F.col("doc").alias("late")).union(dealt.where("hub is not null").select("hub", "doc")).where("late > early")
    few = met.where(f"n between 3 and {rare}").select("sign", "doc")
    every = few.alias("a").join(few.alias("b"), "sign").where("a.doc < b.doc").select(F.col("a.doc").alias("early"), F.col("b.doc").alias("late"))
    return materialize(star.union(every).distinct(), "overlaps"), known


def dedup_lines(docs: DataFrame, rare: int = RARE, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` with shortened ``text``, and the columns n_lines, removed_lines, removed_bytes."""
    spans = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs, known = overlapping(spans, rare, min_bytes)

    def lines(batches):
        for batch in batches:
            data, offs = K.strings(batch.column("text"))
            out, sizes = [], []
            for lo, hi in K.chunks(offs):
                h, size, first = solid_lines(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                for a, b in zip(first[:-1], first[1:], strict=True):
                    out.append(h[a:b].tobytes())
                    sizes.append(size[a:b].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "h": pa.array(out, pa.binary()), "size": pa.array(sizes, pa.binary())})

    def align(batches):
        for batch in batches:
            late, gone, texts = [], [], []
            for x, y, z, d in zip(batch.column("ha"), batch.column("hb"), batch.column("size"), batch.column("late"), strict=True):
                b = np.frombuffer(y.as_buffer(), np.uint64)
                drop = common_lines(np.frombuffer(x.as_buffer(), np.uint64), b, np.frombuffer(z.as_buffer(), np.uint32).astype(np.int64), min_bytes)
                if drop:
                    late.append(d.as_py())
                    gone.append(drop)
                    texts.append(version(b))
            if late:
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(late, pa.int64()), "gone": pa.array(gone, pa.list_(pa.int32())), "version": pa.array(texts, pa.int64())})

    wanted = materialize(pairs.select(F.col("early").alias("doc_id")).union(pairs.select("late")).distinct(), "wanted")
    made = split_by_ids(known, wanted)[0].mapInArrow(lines, "doc_id long, h binary, size binary")
    store = materialize(made.join(wanted.hint("merge"), "doc_id").withColumnRenamed("doc_id", "doc").distinct(), "lines")
    # the lines of a hub (the first document of a large group) are dealt to SALTS places
    hubs = hot_ones(pairs.groupBy("early").agg(F.count("*").alias("n")), pairs.count()).select(F.col("early").alias("doc"))
    salts = F.when(F.col("hub").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    left = store.join(hubs.select("doc", F.lit(1).alias("hub")), "doc", "left").select(F.col("doc").alias("early"), F.col("h").alias("ha"), F.explode(salts).alias("salt"))
    right = store.select(F.col("doc").alias("late"), F.col("h").alias("hb"), "size")
    salted = pairs.join(hubs.select(F.col("doc").alias("early"), F.lit(1).alias("hub")), "early", "left")
    salted = salted.select("early", "late", F.when(F.col("hub").isNull(), 0).otherwise(F.pmod(F.xxhash64("late"), F.lit(SALTS)).cast("int")).alias("salt"))
    cut = salted.join(right, "late").join(left, ["early", "salt"]).select("late", "ha", "hb", "size").mapInArrow(align, "doc_id long, gone array<int>, version long")
    cut = cut.select("doc_id", "version", F.explode("gone").alias("line")).distinct()
    cut = cut.groupBy("doc_id", "version").agg(F.collect_list("line").alias("gone"))
    cut = materialize(cut.groupBy("doc_id").agg(F.collect_list(F.struct("version", "gone")).alias("_cut")), "cut")

    def shorten(batches):
        for batch in batches:
            data, offs = K.strings(batch.column(at))
            out: list = []
            count: tuple[list, list, list] = ([], [], [])
            for i, cuts in enumerate(batch.column("_cut")):
                raw = data[offs[i] : offs[i + 1]]
                n = int((raw == 10).sum()) + 1
                lost: set[int] = set()
                if cuts.is_valid:
                    _, _, _, h = line_hashes(raw, np.array([0, len(raw)]))
                    line = np.flatnonzero(h)
                    mine = version(h[line])
                    gone = {x for c in cuts.as_py() if c["version"] == mine for x in c["gone"]}
                    for x in gone:
                        lost |= {int(line[x // 2])} if x % 2 == 0 else set(range(line[x // 2] + 1, line[x // 2 + 1]))
                text = batch.column(at)[i].as_py()
                new = text if not lost else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in lost)
                out.append(new)
                for c, v in zip(count, (n, len(lost), len(raw) - len((new or "").encode())), strict=True):
                    c.append(v)
            cols = [pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(len(batch.schema.names) - 1)]
            names = batch.schema.names[:-1] + ["n_lines", "removed_lines", "removed_bytes"]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, pa.int64()) for c in count)], names)

    kept = [c for c in docs.columns if c not in ("n_lines", "removed_lines", "removed_bytes")]
    typed = docs.select(*[F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in kept])
    changed, unchanged = split_by_ids(typed, cut)
    joined = changed.join(cut.hint("merge"), "doc_id", "left").select(*kept, "_cut")
    joined = joined.union(unchanged.withColumn("_cut", F.lit(None).cast(joined.schema["_cut"].dataType)))
    at = kept.index("text")
    schema = ", ".join(f"`{c}` {t}" for c, t in joined.drop("_cut").dtypes)
    return joined.mapInArrow(shorten, f"{schema}, n_lines long, removed_lines long, removed_bytes long")


def sql(min_bytes: int = MIN_BYTES, passage: int = PASSAGE) -> str:
    """DuckDB SQL for the query's rows over ``documents``: a line goes exactly if it lies in a sign
    that an earlier document has too."""
    return f"""with t as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as pos from t),
s as (select *, strlen(x) as size, row_number() over w as k, count(*) over (partition by doc_id) as n,
  sum(strlen(x)) over (w rows unbounded preceding) as upto from l where regexp_matches(x, '[^\\x20\\x09-\\x0D]') window w as (partition by doc_id order by pos)),
r as (select a.doc_id, a.k as a, b.k as b, b.upto - a.upto + a.size as total from s a join s b on a.doc_id = b.doc_id and b.k > a.k and b.k <= a.k + {min_bytes} where b.upto - a.upto + a.size >= {min_bytes}),
ends as (select doc_id, a, min(b) as b from r group by doc_id, a union select doc_id, max(a), b from r group by doc_id, b),
g as (select e.doc_id, e.a, e.b, string_agg(s.x, chr(10) order by s.k) as name from ends e join s on s.doc_id = e.doc_id and s.k between e.a and e.b group by e.doc_id, e.a, e.b
  union all select doc_id, k, k, x || chr(10) from s where size >= {passage}
  union all select doc_id, k, k, chr(10) || x from s where n = 1 and size >= {min_bytes}),
h as (select doc_id, a, b, min(doc_id) over (partition by name) < doc_id as held from g),
c as (select distinct h.doc_id, p.pos from h join s f on f.doc_id = h.doc_id and f.k = h.a join s e on e.doc_id = h.doc_id and e.k = h.b
  join l p on p.doc_id = h.doc_id and p.pos between f.pos and e.pos where h.held),
k as (select l.doc_id, string_agg(l.x, chr(10) order by l.pos) filter (where c.pos is null) as kept, count(*) as n_lines, count(c.pos) as removed_lines from l left join c using (doc_id, pos) group by l.doc_id)
select k.doc_id, n_lines, removed_lines, (strlen(t.text) - strlen(coalesce(kept, '')))::bigint as removed_bytes, sha256(coalesce(kept, '')) as kept_sha256 from k join t using (doc_id)"""
