from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import prose
from pyspark.sql import functions as F

from swathe.llm import common, line_dedup, near_dedup, ngram_join, queries, repeat_spans
from swathe.llm import kernels as K

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    ids = sorted({i for i, _ in sets if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def test_ngram_join_on_awkward_rows(documents, awkward):
    got = ngram_join.jaccard_components(documents(awkward)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected_components(awkward)


def test_ngram_join_on_chains_and_groups(documents):
    words = prose(9, 100).split()
    rows = [(i, " ".join([*words[: 100 - 2 * i], *(f"w{i}x{j}" for j in range(2 * i))])) for i in range(12)]
    rows += [(100 + i, " ".join([*words[:50], f"u{i}", *words[51:]])) for i in range(40)]
    rows += [(200 + i, prose(50 + i, 40) + " " + prose(7, 30)) for i in range(30)]
    got = ngram_join.jaccard_components(documents(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected_components(rows)


def test_ngram_join_on_repeated_ids_with_other_texts(documents):
    a, b = prose(21, 60), prose(22, 60)
    rows = [(9, a), (9, b), (3, a + " tail"), (5, b + " tail"), (5, None), (7, prose(23, 30)), (7, ""), (8, None), (8, ""), (None, a), (4, prose(24, 40)), (4, prose(24, 40)), (4, prose(25, 40))]
    for seed in (0, 1):
        order = np.random.default_rng(seed).permutation(len(rows))
        df = documents([rows[i] for i in order]).repartition(5)
        got = sorted((tuple(r) for r in ngram_join.jaccard_components(df).collect()), key=str)
        assert got == expected_components(rows)
    assert {c for i, _, c in got if i in (3, 5, 9)} == {3}


def test_ngram_join_expands_groups_that_do_not_hang_together(documents, monkeypatch):
    """Sets of one prefix and size that differ in the rest: each group has several parts."""
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    monkeypatch.setattr(ngram_join, "MORE_PIVOTS", 2)
    monkeypatch.setattr(ngram_join, "prefix_of", grouped_prefix(ngram_join.prefix_of))
    rows = [(i * 7 % 101, prose(60 + i % 5, 30) + " " + prose(80 + i % 3, 12 + i % 2) + f" {i % 8} {i % 4}") for i in range(60)]
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(documents(rows)).collect()), key=str)
    assert got == expected_components(rows)


def test_tokens_compared_whole_are_not_placed_again(documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    written = []

    def recorded(df, tag, real=ngram_join.materialize):
        out = real(df, tag)
        written.append((tag, df, out))
        return out

    monkeypatch.setattr(ngram_join, "materialize", recorded)
    common = [prose(800 + j, 60 + j) for j in range(12)]
    rows = [(1000 + 40 * j + i, text) for j, text in enumerate(common) for i in range(30)]
    rows += [(i, prose(900, 22) + " " + text) for i, text in enumerate(common)]  # a token with many parts
    rows += [(100 + 2 * i + x, prose(910 + i, 22) + " " + common[x * 2 + i]) for i in range(4) for x in (0, 1)]  # tokens with two
    got = ngram_join.jaccard_components(documents(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected_components(rows)
    spread = [(df, [r["count"] for r in out.groupBy("token").count().collect()]) for tag, df, out in written if tag == "spread"]
    assert 2 in spread[0][1] and max(spread[0][1]) > 2 and len(spread) > 1
    assert all(min(sizes, default=9) > 2 for _, sizes in spread[1:])
    # groups meet their parts once a step
    assert all(df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1 for df, _ in spread)


def grouped_prefix(real):
    def prefix_of(s, ranks, num, den):
        tokens, classes, _ = real(s, ranks, 0, den)  # whole sets as prefixes, few of them kept
        return tokens * 0 + np.arange(len(tokens)) % 3, classes, len(s) % 5

    return prefix_of


def test_ngram_join_on_nothing(documents):
    assert ngram_join.jaccard_components(documents([])).count() == 0


def test_hot_tokens_are_dealt_by_class(documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_FACTOR", 2)
    rows = [(i, prose(3, 60) + f" end{i} {i}") for i in range(60)] + [(100 + i, prose(200 + i, 50)) for i in range(20)]
    got = ngram_join.jaccard_components(documents(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected_components(rows)


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            else:
                seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i, t] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return sorted(((i, *out[i, t]) for i, t in rows), key=str)


def run_repeats(documents, rows):
    return sorted((tuple(r) for r in repeat_spans.remove_repeats(documents(rows)).drop("kept").collect()), key=str)


def test_repeats_on_awkward_rows(documents, awkward):
    rows = [(i, t if t is None else t[:6000]) for i, t in awkward] + [(11, "another text of the same id " * 9)]
    assert run_repeats(documents, rows) == brute_repeats(rows)
    assert run_repeats(documents, []) == []


def test_repeats_in_many_places(documents):
    passage, rows = prose(4, 40), []
    for i in range(60):
        rows.append((i, prose(300 + i, i % 7 * 6) + " " + passage[i % 5 : len(passage) - i % 11] + " " + prose(400 + i, 5 + i % 4)))
    rows += [(100, "ab" * 400), (101, passage + passage), (102, "x" * 99), (103, "x" * 101), (104, "é" * 120)]
    assert run_repeats(documents, rows) == brute_repeats(rows)


def test_hot_anchors_give_the_same_rows(documents, monkeypatch):
    monkeypatch.setattr(repeat_spans, "hot_buckets", lambda docs: b"\1" * (1 << repeat_spans.SKETCH_BITS))
    rows = [(i, prose(500 + i, 10) + " " + prose(5, 30) + " " + prose(600 + i, 3)) for i in range(25)]
    assert run_repeats(documents, rows) == brute_repeats(rows)


def test_rare_anchors_are_not_hot(spark, monkeypatch):
    monkeypatch.setattr(repeat_spans, "HOT_ROWS", 4)
    rng = np.random.default_rng(3)
    rows = [(i, "".join(chr(c) for c in rng.integers(97, 123, 5000))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc long, text string").select("doc", F.lit(0).alias("ver"), "text")
    assert np.frombuffer(repeat_spans.hot_buckets(docs), np.uint8).sum() < 5


def test_the_sketch_of_anchors_comes_to_the_driver_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeat_spans, "HOT_ROWS", 4)
    rows = [(i, prose(i, 2000)) for i in range(60)] + [(100 + i, prose(4, 14) + " " + prose(1000 + i, 12)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc long, text string").select("doc", F.lit(0).alias("ver"), "text")
    total = np.zeros(1 << repeat_spans.SKETCH_BITS, np.int64)
    for batch in docs.toArrow().to_batches():
        for _, _, _, (_, _, _, _, key, name, _, _) in repeat_spans._runs(batch, strong=False):
            total += np.bincount(repeat_spans.sketched(np.array(sorted({(k, n) for k, n in zip(key.tolist(), name.tolist(), strict=True)}), np.uint64)[:, 0]), minlength=len(total))
    came = []
    for how in ("collect", "toPandas"):
        real = getattr(type(docs), how)
        monkeypatch.setattr(type(docs), how, lambda df, real=real: came.append(len(x := real(df))) or x)
    hot = np.frombuffer(repeat_spans.hot_buckets(docs), np.uint8)
    assert hot.sum() > 0 and (hot == (total > max(4, repeat_spans.HOT_FACTOR * total.sum() / len(total)))).all()
    assert sum(came) <= 1024


def test_repeats_in_a_very_long_text(documents):
    rows = [(1, "x" * 9_000_000), (2, "y" + "x" * 200)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_spans.remove_repeats(documents(rows)).drop("kept").collect()}
    assert got[1] == (9_000_000, 8_999_999, 1, hashlib.sha256(b"x").hexdigest())
    assert got[2] == (201, 200, 1, hashlib.sha256(b"y").hexdigest())


def test_names_tell_runs_apart_that_share_their_polynomial_hashes(documents, monkeypatch):
    """Only the anchors' hashes collide here; digests keep the runs apart, the sort compares bytes."""
    real = K.span_hash
    monkeypatch.setattr(K, "span_hash", lambda pre, a, b: real(pre, a, b) & np.uint64(3))
    rows = [(i, prose(700 + i, 40) + " " + prose(6, 30)) for i in range(6)]
    found = [repeat_spans.anchors(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for _, t in rows]
    text = {(k, n): t.encode()[s : s + c + 99] for (_, t), (_, _, count, _, key, name, _, start) in zip(rows, found, strict=True) for k, n, c, s in zip(key, name, count, start, strict=True)}
    for (_, t), (_, _, count, _, key, name, _, start) in zip(rows, found, strict=True):
        assert all(text[k, n] == t.encode()[s : s + c + 99] for k, n, c, s in zip(key, name, count, start, strict=True))


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    pos = rng.permutation(2800)[:500]
    order = repeat_spans.merge_sort(K.prefix(data), data, pos, np.zeros(500, np.int64))
    raw = data.tobytes()
    suffixes = [raw[p : p + repeat_spans.LENGTH] for p in pos[order]]
    assert suffixes == sorted(suffixes)


def test_patience_blocks():
    assert line_dedup.patience([1, 2, 3, 4], [1, 2, 9, 3, 4]) == [(0, 0, 2), (2, 3, 2)]
    assert line_dedup.patience([], [1]) == [] and line_dedup.patience([1, 1, 1], [1, 1]) == [(0, 0, 2)]
    assert line_dedup.patience([5, 1, 2, 3], [1, 2, 3, 5]) == [(1, 0, 3)]


def test_repeated_lines_are_aligned(monkeypatch):
    assert line_dedup.patience([1, 2, 1, 2], [9, 1, 2, 8]) in ([(0, 1, 2)], [(2, 1, 2)])
    assert line_dedup.patience([3, 1, 2, 7, 1, 2], [1, 2, 1, 2, 5]) == [(1, 0, 2), (4, 2, 2)]
    assert line_dedup.patience([1, 5, 0, 1, 2], [6, 0, 1, 2, 0, 1]) == [(2, 1, 3)]  # a blank line is no anchor
    rng = np.random.default_rng(8)
    for most in (1 << 28, 40):
        monkeypatch.setattr(line_dedup, "MATRIX", most)
        for _ in range(60):
            a, b = (rng.integers(1, 5, rng.integers(0, 30)).tolist() for _ in "ab")
            best = np.zeros((len(a) + 1, len(b) + 1), int)
            for i, j in itertools.product(range(len(a)), range(len(b))):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
            got = line_dedup.longest(a, b)
            assert len(got) == best[-1, -1] and all(a[i] == b[j] for i, j in got)
            assert all(x < y and p < q for (x, p), (y, q) in itertools.pairwise(got))


def test_line_dedup(documents):
    lines = [prose(i, 8) for i in range(12)]
    boiler = "released under a licence that everybody uses"
    rows = [
        (1, "\n".join(lines)),
        (2, "\n".join([*lines[:5], "a line of its own here, quite long", *lines[5:]])),
        (3, "\n".join(lines)),
        *((10 + i, prose(900 + i, 9) + "\n" + boiler) for i in range(20)),
        (50, None),
        (51, ""),
        (None, "\n".join(lines)),
    ]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(documents(rows)).collect()}
    assert len(out) == len(rows) and out[1].removed_lines == 0
    assert out[2].text == "a line of its own here, quite long" and out[2].removed_lines == 12
    assert out[3].text == "" and out[3].removed_bytes == len(rows[0][1])
    assert all(out[10 + i].removed_lines == 0 for i in range(20))  # one frequent line is no overlap
    assert out[50].text is None and out[51].text == "" and out[None].removed_lines == 0
    assert set(documents(rows).columns) <= set(out[1].asDict())
    assert line_dedup.dedup_lines(documents([])).count() == 0


def test_large_groups_of_copies_lose_all_but_the_first(documents):
    lines = [prose(i, 8) for i in range(4)]
    rows = [(i, "\n".join([*lines, f"number {i} has this last line"])) for i in range(30)]
    out = {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(documents(rows)).collect()}
    assert out[0] == 0 and all(out[i] == 4 for i in range(1, 30))


def test_large_groups_are_found_by_passages_single_lines_and_parted_paragraphs(documents):
    passage, short, parts = prose(70, 40), prose(71, 4), [prose(72 + i, 8) for i in range(3)]
    rows = [(i, f"{prose(100 + i, 9)}\n{passage}\n{prose(200 + i, 9)}") for i in range(12)]
    rows += [(100 + i, short) for i in range(12)]
    rows += [(200 + i, "\n\n".join([*parts, f"number {i} has this last line"])) for i in range(12)]
    assert len(passage) >= 100 and 20 <= len(short) < 100 and line_dedup.RARE < 12
    out = {r.doc_id: r for r in line_dedup.dedup_lines(documents(rows)).collect()}
    assert [out[k].removed_lines for k in (0, 100, 200)] == [0, 0, 0]
    for i in range(1, 12):
        assert out[i].removed_lines == 1 and passage not in out[i].text
        assert out[100 + i].text == ""
        assert out[200 + i].text.strip() == f"number {i} has this last line"


def expected_lines(rows):
    """All pairs, all common runs: the lines that stay of each (doc_id, text)."""
    kept = []
    for i, text in rows:
        lines = (text or "").split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip(" \t\r\v\f")]
        gone: set[int] = set()
        for j, other in rows:
            if i is None or j is None or j >= i:
                continue
            theirs = [x for x in (other or "").split("\n") if x.strip(" \t\r\v\f")]
            for a, b in itertools.product(range(len(solid)), range(len(theirs))):
                n = 0
                while a + n < len(solid) and b + n < len(theirs) and lines[solid[a + n]] == theirs[b + n]:
                    n += 1
                size = sum(len(lines[k].encode()) for k in solid[a : a + n])
                if n > 1 and size >= 20 or n and len(theirs[b].encode()) >= 100 or len(solid) == len(theirs) == n == 1 and size >= 20:
                    if n == 1 or size >= 20:
                        gone |= set(range(solid[a], solid[a + n - 1] + 1))
        kept.append((i, text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(kept, key=str)


def generated_lines(rng, copies):
    """Documents of shared, moved, short, blank and own lines, one-liners, and groups of copies."""
    pool = [prose(int(x), 1 + int(x) % 14)[: int(rng.integers(3, 140))] for x in rng.integers(0, 10_000, 14)] + ["", " ", "x", "ab"]
    rows = []
    for i in range(12):
        parts = [pool[int(x)] if x < len(pool) else prose(int(x) + 99 * i, 9) for x in rng.integers(0, len(pool) + 6, int(rng.integers(1, 14)))]
        rows.append((int(rng.integers(0, 900)), "\n".join(parts)))
    group = "\n\n".join(prose(3000 + k, 8) for k in range(4))
    rows += [(1000 + i, group) for i in range(copies)] + [(3000 + i, "one line of this group") for i in range(copies)]
    rows += [(5000 + i, f"{prose(i, 9)}\nthe same short line of text\n{prose(i + 50, 9)}") for i in range(copies)]
    return rows


def test_line_dedup_equals_all_pairs_in_groups_of_any_size(documents, monkeypatch):
    monkeypatch.setattr(common, "HOT", 12)
    for seed, copies in enumerate((2, 8, 9, 30)):
        rows = generated_lines(np.random.default_rng(seed), copies)
        got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(documents(rows)).collect()), key=str)
        if len({i for i, _ in rows}) == len(rows):
            assert got == expected_lines(rows)
        unique = list({i: (i, t) for i, t in rows}.values())
        got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(documents(unique)).collect()), key=str)
        assert got == expected_lines(unique)


def test_every_copy_of_a_thousand_loses_the_same(documents):
    text = "\n\n".join(prose(40 + k, 8) for k in range(6))
    rows = [(i, text) for i in range(1000)] + [(2000 + i, "a document of one line") for i in range(1000)]
    out = line_dedup.dedup_lines(documents(rows)).groupBy("removed_lines").count().collect()
    assert {r.removed_lines: r["count"] for r in out} == {0: 2, 11: 999, 1: 999}


def test_alignment_finds_moved_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    for moves in (8, 0):
        monkeypatch.setattr(line_dedup, "MOVES", moves)
        for _ in range(150):
            text = {i: "x" * int(s) + str(i) for i, s in enumerate(rng.choice([2, 5, 12, 30, 110], 7))}
            a, b = ("\n".join(text[int(x)] for x in rng.integers(0, 7, rng.integers(1, 12))) for _ in "ab")
            raw = [K.strings(pa.array([t])) for t in (a, b)]
            (ha, _, _), (hb, size, _) = (line_dedup.solid_lines(*r) for r in raw)
            gone = line_dedup.common_lines(ha, hb, size)
            kept = "\n".join(x for k, x in enumerate(b.split("\n")) if 2 * k not in gone)
            assert (2, kept if gone else b) in expected_lines([(1, a), (2, b)])


def test_line_dedup_equals_its_sql(spark, documents, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = list({i: (i, t) for i, t in generated_lines(np.random.default_rng(77), 9)}.values()) + [(9000, None), (9001, ""), (9002, "é" * 60)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(line_dedup.sql()).fetchall())
    assert sorted(tuple(r) for r in queries.op7_line_alignment_dedup(spark, str(tmp_path)).collect()) == want


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep long, v string")


def test_near_dedup(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    monkeypatch.setattr(near_dedup, "CLUSTER", 30)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 16))
    rows, vecs = [], {}
    for i in range(300):
        v = (base[i % 20] + rng.normal(size=16) * (0.02 if i % 3 else 0.3)).astype(np.float32)
        vecs[i] = (v, i % 2)
        rows.append((i, [float(x) for x in v], i % 2, 0, ""))
    bad = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 1), (1003, [float("inf")] + [1.0] * 15, 1), (1004, rows[0][1], None), (1005, [1.0, None] * 8, 0), (1006, [], 0), (None, rows[0][1], 0)]
    rows += [(*b, 0, "") for b in bad] + [(2000, rows[0][1], 0, 0, ""), rows[5]]
    vecs[2000] = vecs[0]
    out = near_dedup.near_components(vectors(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    ids = list(vecs)
    parent, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        x, y = vecs[a][0].astype(float), vecs[b][0].astype(float)
        if vecs[a][1] == vecs[b][1] and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
            links[a] += 1
            links[b] += 1
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    assert {i: got[i] for i in ids} == {i: (links[i], find(i), find(i) == i) for i in ids}
    for b in bad[:-1]:
        assert got[b[0]] == (0, b[0], True)
    assert near_dedup.near_components(vectors(spark, [])).count() == 0


def threshold_groups(seed, groups, members, dim=64):
    """Vectors of groups whose members lie around cosine 0.98 of each other."""
    rng = np.random.default_rng(seed)
    base = near_dedup.unit(rng.normal(size=(groups, dim)))
    return np.repeat(base, members, axis=0) + rng.normal(size=(groups * members, dim)) * np.sqrt(0.0204 / dim)


def links_of(x, threshold=0.98):
    y = near_dedup.unit(x)
    s = y @ y.T >= threshold
    np.fill_diagonal(s, False)
    return s


@pytest.mark.parametrize(("groups", "members"), [(30, 20), (600, 1), (1, 500), (3, 150)])
def test_range_search_on_the_pruned_graph_alone(groups, members):
    x = near_dedup.unit(threshold_groups(5, groups, members))
    n = len(x)
    lists = near_dedup.robust_prune(x @ x.T)
    tail, at = np.nonzero(lists >= 0)
    head = lists[tail, at]
    pair = np.unique(np.concatenate([tail * n + head, head * n + tail]))
    hit, visited = near_dedup.range_search(x, np.searchsorted(pair, np.arange(n + 1) * n), pair % n, 0.98, 1 + 1 / near_dedup.ALPHA)
    assert (hit == links_of(x)).all()
    assert visited < n * n / 2 or groups < 10


def test_near_dedup_of_groups_at_the_threshold(spark):
    x = threshold_groups(6, 40, 50)
    report = {}
    out = near_dedup.near_components(vectors(spark, [(i, v.tolist(), 0, 0, "") for i, v in enumerate(x.astype(np.float32))]), report=report).collect()
    want = links_of(x.astype(np.float32).astype(float)).sum(1)
    got = np.array([r.n_links for r in sorted(out, key=lambda r: r.vec_id)])
    assert want.sum() > 10_000 and (got <= want).all() and got.sum() >= near_dedup.RECALL * want.sum()
    print(report, got.sum() / want.sum())
    assert report["recall"] >= near_dedup.RECALL and report["scanned"] * 4 < report["shards"] and report["audited_links"] > 5000


def test_overlap_grows_until_the_audit_holds(spark, monkeypatch):
    """One centroid a vector and many centroids: the first placing loses links, the audit sees it."""
    monkeypatch.setattr(near_dedup, "OVERLAP", 1)
    monkeypatch.setattr(near_dedup, "CLUSTER", 4)
    x = threshold_groups(7, 3, 60, 16)
    report = {}
    out = near_dedup.near_components(vectors(spark, [(i, v.tolist(), 0, 0, "") for i, v in enumerate(x.astype(np.float32))]), report=report).collect()
    want = links_of(x.astype(np.float32).astype(float)).sum()
    assert report["overlap"] > 1 and report["recall"] >= near_dedup.RECALL and sum(r.n_links for r in out) >= near_dedup.RECALL * want


def test_bitmaps_lose_no_link():
    rng = np.random.default_rng(8)
    for _ in range(400):
        n, m = (int(x) for x in rng.integers(1, 400, 2))
        both = int(rng.integers(0, min(n, m) + 1))
        every = rng.integers(0, 1 << 64, n + m, np.uint64, endpoint=False)
        a, b = every[:n], every[n - both : n + m - both]
        d = ngram_join.apart(*(np.frombuffer(ngram_join.bitmap(x), np.uint8) for x in (a, b)))
        assert d <= n + m - 2 * both and (d > 0 or n + m == 2 * both or both or n + m < 20)
        assert (n + m - 2 * both - d) % 2 == 0
        if n == m and both == 0 and n > 50:
            assert 180 * d > 20 * (n + m)
