from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pytest
from helpers import prose
from pyspark.sql import functions as F

from swathe.llm import ann, chat, html_extract, mixing, packing, queries, toxicity

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 12)).astype(np.float32)
    x[7] = x[9]
    rows = [(i, [float(v) for v in x[i]], "x") for i in range(600)]
    rows += [(1000, None, ""), (1020, [0.0] * 12, ""), (1040, [float("nan")] * 12, ""), (1060, [1.0] * 5, ""), (None, rows[0][1], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, bucket string")
    out = ann.nearest(df, F.pmod("vec_id", F.lit(20)) == 0, k=10).collect()
    got: dict[int, list] = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20)) and all(len(v) == 10 for v in got.values())
    hit = 0
    d = x.astype(float)
    for q, found in got.items():
        s = d @ d[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:10]
        hit += len({int(w) for w in want} & {v for v, _ in found})
        assert all(score == pytest.approx(s[v], abs=1e-9) for v, score in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
    assert hit / (10 * len(got)) >= 0.9
    few = ann.nearest(df.where("vec_id < 5"), F.lit(True), k=10)
    assert few.count() == 20
    assert ann.nearest(df.where("false"), F.lit(True)).count() == 0


def _shuffled(spark) -> int:
    return sum(s.shuffleWriteBytes() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))


def test_neighbours_shuffle_rows_once_a_table(spark):
    x = np.random.default_rng(6).normal(size=(3000, 256)).astype(np.float32)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(3000)], "vec_id long, embedding array<float>").repartition(4).persist()
    df.count()
    before = _shuffled(spark)
    assert ann.nearest(df, F.lit(True), k=2).count() == 6000
    assert _shuffled(spark) - before < 5 * x.nbytes
    df.unpersist()


def test_neighbours_in_rounds_and_among_copies(spark, monkeypatch):
    x = np.random.default_rng(7).normal(size=(400, 8)).astype(np.float32)
    x[300:] = x[3]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(399, -1, -1)] + [(350, x[3].tolist())], "vec_id long, embedding array<float>")
    once = sorted(tuple(r) for r in ann.nearest(df, F.lit(True), k=5).collect())
    monkeypatch.setattr(ann, "ROUND_BYTES", 30000)
    monkeypatch.setattr(ann, "QUERIES", 64)
    assert sorted(tuple(r) for r in ann.nearest(df, F.lit(True), k=5).collect()) == once
    d = x.astype(float)
    hit = 0
    for q in range(400):
        score = (d * d[q]).sum(1)
        score[q] = -np.inf
        want = np.lexsort((np.arange(400), -score))[:5]
        got = [v for i, _, v, _ in once if i == q]
        hit += len(set(got) & set(want.tolist()))
        if q == 3 or q >= 300:
            assert got == [int(i) for i in (3, *range(300, 400)) if i != q][:5] or score[want[0]] > score[300 if q != 300 else 301]
    assert hit >= 0.9 * 2000 and len(once) == 2000


def test_best_fit_plan():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 65, 500).tolist()
    hist: dict[int, int] = {}
    for n in lengths:
        hist[n] = hist.get(n, 0) + 1
    plan = packing.best_fit_decreasing(hist, 64)
    room: dict[int, list] = {}
    for length, _, count, first, offset in plan:
        for w in range(first, first + count):
            room.setdefault(w, []).append((offset, length))
    assert sum(len(v) for v in room.values()) == 500
    for spans in room.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    # the textbook algorithm, one piece at a time, opens as many windows
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, b in enumerate(bins) if b >= n]
        i = min(fit, key=lambda i: bins[i]) if fit else len(bins)
        if not fit:
            bins.append(64)
        bins[i] -= n
    assert len(room) == len(bins) and set(room) == set(range(len(bins)))
    assert packing.best_fit_decreasing({}, 64) == []


def test_packing(documents, awkward):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rows = [*awkward, (20, "<|endoftext|> it's   á İx"), (21, "  \x0b \x1c")]
    out = packing.pack(documents(rows), capacity=256).collect()
    by: dict = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want = sorted((s, min(256, len(ids) - s), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 256))
        copies = sum(1 for j, _ in rows if j == i)
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by[i]) == sorted(want * copies)
    seqs: dict = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(documents([])).count() == 0


def test_pages():
    page = "<!doctype html><html><head><title>x</title></head><body><nav><a>menu</a></nav><header>h</header><article><h1>A &amp; B</h1><p>one\n two<br>three<p>four <b>bold<p>five</b></p><form>no</form><div class='ad'>no</div><aside>no</aside><section id=comments><p>no</section><script>if(a<b){'</p>'}</script><ul><li>x<li>y</ul></article><footer>f</footer>"
    assert html_extract.main_texts([page]) == ["A & B\n\none two three\n\nfour bold\n\nfive\n\nx\n\ny"]
    assert html_extract.main_texts(["", "plain <b>text</b>", "<p>a<table><tr><td>1<td>2</table>"]) == ["", "plain text", "a\n\n1\n\n2"]
    deep = "<div>" * 3000 + "deep"
    assert html_extract.main_texts([deep]) == ["deep"]
    site = ["<body><div><span>The site</span></div><div class=c><p>text %d</p><p>more %d</p></div><div class=d>All rights</div></body>" % (i, i) for i in range(6)]
    assert html_extract.main_texts(site)[3] == "text 3\n\nmore 3"  # constant slots are template
    assert html_extract.main_texts(site[:2])[0].startswith("The site")  # too few pages to tell


def test_class_words_do_not_drop_whole_pages():
    words = ("<body class='single has-sidebar'><article class='post category-social tag-legal'><p>text</p></article>", "<html class=header><body id=search><main class='form'><p>text</p></main>", "<div class='sidebar widget'><article class=notice><p>text</article></div>")
    assert html_extract.main_texts(list(words)) == ["text"] * 3
    assert html_extract.main_texts(["<article><p>text<div class='no-ad x'>a</div><div class='x ad'>b</div></article><div class=comments><article><p>a long comment</article></div>"]) == ["text\n\na"]
    assert html_extract.main_texts(["<div>a text</div><div class=comments><article>short</article></div>"]) == ["a text"]


def test_all_articles_are_kept():
    assert html_extract.main_texts(["<div>menu</div><article><p>one</article><div class=x><article><p>two<article>in two</article></article></div>", "<p>out</p><main><p>before</p><article>three</article></main>"]) == ["one\n\ntwo\n\nin two", "before\n\nthree"]


def test_large_pages_have_the_same_wrapper(spark):
    def page(i, filler):
        return f"<body><div><span>The site</span></div><!-- {filler} --><div class=c><p>text {i}</p></div><div class=d>All rights</div></body>"

    def texts(filler):
        rows = [(i, "http://h.example.com/", page(i, filler)) for i in range(9)]
        return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}

    assert texts("x") == texts("x" * 6_000_000) == {i: f"text {i}" for i in range(9)}


def test_markup_is_scanned_in_linear_time():
    import time

    began = time.perf_counter()
    for page in ('<a "' * 250_000, "<a \"'>" * 30_000, "<b>" * 5000 + "</i>" * 5000, "<" * 100_000, "<p " * 100_000):
        html_extract.main_texts([page])
    assert time.perf_counter() - began < 60


def test_what_an_article_says_stays():
    page = "<article><h2 class='section-header'>Kept heading</h2><p>one</p><p>E = <math><mi>m</mi></math> c</p><p>a <label>b</label></p><div class='legal-history'>two</div><p class='share-price'>three</p></article>"
    assert html_extract.main_texts([page]) == ["Kept heading\n\none\n\nE = m c\n\na b\n\ntwo\n\nthree"]


def template_pages(seed, n, host):
    """Pages of a known template without any telling mark, and their contents."""
    rng = np.random.default_rng(seed)
    menu, legal, side = (prose(int(x), 6) for x in rng.integers(0, 9999, 3))
    out = []
    for i in range(n):
        body = [prose(int(x), 4 + int(x) % 30) + f" {seed} {i}" for x in rng.integers(0, 9999, int(rng.integers(1, 7)))]
        page = f"<html><body><div class=a><span>{menu}</span></div><div class=b><div class=c>{side}</div><div class=e>" + "".join(f"<p>{x}</p>" for x in body) + f"</div></div><div class=z>{legal}</div></body></html>"
        out.append((f"http://{host}/{i}", page, "\n\n".join(body)))
    return out


def test_induction_alone_finds_the_content_of_hosts_of_any_size(spark):
    """No page has an article, main, nav or the like: only alignment tells template from content."""
    sites = [template_pages(s, n, f"h{s}.example.com") for s, n in enumerate((4, 30, 700))]
    rows = [(k, u, h) for k, (u, h, _) in enumerate(x for site in sites for x in site)]
    want = {k: t for k, (_, _, t) in enumerate(x for site in sites for x in site)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df, group=64).collect()} == want
    assert {r.page_id: r.text for r in html_extract.extract(df.repartition(7), group=1000).collect()} == want
    few = template_pages(9, 3, "few.example.com")
    assert all(got.count("\n\n") >= text.count("\n\n") + 3 for got, (_, _, text) in zip(html_extract.main_texts([h for _, h, _ in few]), few, strict=True))


def test_a_slot_that_differs_from_the_template_stays():
    site = [f"<body><div class=t>The site</div><p>text {i}</p></body>" for i in range(80)] + ["<body><div class=t>A note of this page</div><p>text x</p></body>"]
    out = html_extract.main_texts(site)
    assert out[3] == "text 3" and out[80] == "A note of this page\n\ntext x"


def test_tree_matching():
    a, b = (html_extract.shape([html_extract.parse(p)]) for p in ("<div><p>1<ul><li>2</ul></div>", "<div><h1>t</h1><p>1<p>2<ul><li>2<li>3</ul></div>"))
    pairs: list = []
    assert html_extract.match(a, b, pairs) == 5 and len(pairs) == 5


def test_extract(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", f"<body><article><p>text {i}</p></article></body>", "z") for i in range(20)]
    rows += [(50, None, None, ""), (51, "no url", "<p>x", ""), rows[0]]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, salt string")).collect()
    assert len(out) == len(rows)
    got = {r.page_id: (r.text, r.n_chars) for r in out}
    assert got[3] == ("text 3", 6) and got[50] == ("", 0) and got[51] == ("x", 1)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@needs_data
def test_mixing_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = queries.op6_mix_to_targets(spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.sql(mixing.sql()).df().sort_values("doc_id").reset_index(drop=True)
    assert list(got.columns) == list(want.columns) and (got == want).all().all()


def test_mixing_meets_marginals(spark, documents, awkward):
    rows = [(i, prose(i, 20 + i % 9), ("en", "de")[i % 5 == 0], f"s{i % 3 == 0}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df)
    shares = {}
    for d, power in (("source", 0.7), ("lang", 0.8)):
        r = out.groupBy(d).agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("weight")).alias("w")).collect()
        p = {x[d]: x.t**power for x in r}
        for x in r:
            shares[d, x[d]] = (x.w / sum(y.w for y in r), (x.t / sum(y.t for y in r)) ** power / sum((y.t / sum(z.t for z in r)) ** power for y in r))
        assert p
    assert all(a == pytest.approx(b, rel=1e-6) for a, b in shares.values())
    assert out.agg(F.max("probability")).first()[0] == pytest.approx(1)
    counted = mixing.mix(documents([(1, " a  b\n\nc "), (2, " "), (3, "x")]))
    assert {r.doc_id: r.tokens for r in counted.collect()} == {1: 3, 2: 0, 3: 1}
    odd = mixing.mix(documents(awkward))
    assert odd.count() == len(awkward) and odd.where("tokens = 0 and sampled").count() == 0
    assert mixing.mix(documents([])).count() == 0


def test_chat_round_trip():
    for text in (r"\### Assistant: </turn> ok", "", "\\", "a\\#<\n### User: x</turn>\n", "日本 "):
        for role in ("user", "assistant", "User", "a:b#", "", "Assistant", "\\User", "system"):
            f, mask = chat.render([(role, text), ("assistant", text)])
            assert chat.parse(f) == [(role, text), ("assistant", text)]
            assert chat.unescape(f[mask[-1][0] : mask[-1][1]]) == text
    with pytest.raises(ValueError):
        chat.parse("nonsense")


def test_chat_events(spark):
    rows = [
        (1, 0, "message", "a", "user", "hi"),
        (1, 3, "delta", "b", "assistant", "lo"),
        (1, 2, "delta", "b", "assistant", "hel"),
        (1, 4, "regenerate", "b", None, None),
        (1, 5, "delta", "b", "assistant", "new"),
        (1, 6, "edit", "a", None, "hello"),
        (1, 7, "message", "c", "user", "gone"),
        (1, 8, "delete", "c", None, None),
        (2, None, "message", None, "user", None),
        (2, None, "message", None, "user", None),
        (None, 1, "message", None, None, "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message string, role string, text string")
    out = {r.conv_id: chat.parse(r.formatted) for r in chat.format_conversations(df).collect()}
    assert out == {1: [("user", "hello"), ("assistant", "new")], 2: [("user", ""), ("user", "")], None: [("", "x")]}
    assert chat.format_conversations(df.where("false")).count() == 0


@needs_data
def test_chat_query(spark):
    got = {r.conv_id: r for r in queries.op8_event_sourced_chat(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect()
    said: dict = {}
    for r in rows:
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(got) == {*said, -7}
    for i, turns in said.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[i].n_turns == len(turns) and got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_deobfuscation(spark):
    words = "the idiot was a stupid moron and the trash was pathetic " * 50
    model = toxicity.trigram_model(spark.createDataFrame([(words,)], "text string"))
    restorer = toxicity.Restorer(model)
    restore = lambda s: toxicity.SPELLING.sub(restorer.word, s.encode()).decode()
    assert [restore(s) for s in ("1d10t", "i d i o t", "iiidiooot", "m0r0n", "$tup1d", "tr@sh", "m-o-r-o-n")] == ["idiot", "idiot", "idiot", "moron", "stupid", "trash", "moron"]
    assert restore("the end. A b c") == "the end. A b c"


def test_decoding_finds_the_best_path(monkeypatch):
    rng = np.random.default_rng(3)
    model = np.log(rng.dirichlet(np.ones(27), (27, 27)))

    def best(low):
        paths = {(0, 0): [(0.0, "")]}
        for i in range(len(low)):
            new: dict = {}
            for letter, cost in toxicity._arcs(low, i):
                for (b, c), found in paths.items():
                    for v, out in found:
                        to, w = ((c, letter), v + cost + model[b, c, letter]) if letter else ((b, c), v + cost)
                        new.setdefault(to, []).append((w, out + chr(96 + letter) if letter else out))
            paths = new
        return max((v + model[b, c, 0], out) for (b, c), found in paths.items() for v, out in found)[1]

    for stride in (512, 2):
        monkeypatch.setattr(toxicity, "STRIDE", stride)
        for s in ("1d10t", "aab@@cd", "h6ll0", "x-y_z", "aaa", "$tupp!d", "b", "66", "a1b2cc", "ab*cd*"):
            assert toxicity.decode(s, model) == best(s)
    assert toxicity.decode("a" * 500, model) == toxicity.decode("aaa", model)


def test_long_unbroken_texts_are_scanned_in_linear_time():
    import time

    restorer = toxicity.Restorer(np.log(np.full((27, 27, 27), 1 / 27)))
    began = time.perf_counter()
    for part in (b"x", b"abcdefgh", b"ab1", b"a-"):
        raw = np.frombuffer(part * (1_000_000 // len(part)), np.uint8)[:200_000 if part == b"a-" else 1_000_000]
        out, offs = restorer.texts(raw, np.array([0, len(raw)]))
        assert offs[-1] == len(out)
    assert time.perf_counter() - began < 120


def test_candidates_hold_every_spelling():
    rng = np.random.default_rng(4)
    restorer = toxicity.Restorer(np.log(np.full((27, 27, 27), 1 / 27)))
    letters = np.frombuffer("aabcdei01$@!*. -_#(é\n".encode(), np.uint8)
    for _ in range(800):
        sizes = rng.integers(0, 30, 4)
        offs = np.concatenate([[0], np.cumsum(sizes)])
        data = rng.choice(letters, offs[-1])
        out, at = restorer.texts(data, offs)
        for i in range(4):
            assert out[at[i] : at[i + 1]].tobytes() == toxicity.SPELLING.sub(restorer.word, data[offs[i] : offs[i + 1]].tobytes())


def test_toxicity_columns_of_the_same_name_are_replaced(spark, documents):
    df = documents([(1, "x" * 5000), (2, "good words")]).withColumn("score", F.lit("old")).withColumn("predicted", F.lit("old"))
    out = toxicity.score(df, spark.createDataFrame([(2, 0)], "doc_id long, toxic int")).collect()
    assert len(out) == 2 and all(isinstance(r.score, float) and r.predicted == 0 for r in out)


def test_toxicity_scores(spark, documents, awkward):
    rows = [(100 + i, prose(i, 30) + (" idiot moron " if i % 4 == 0 else " ") + prose(i + 999, 5)) for i in range(200)] + awkward
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(200)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(documents(rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id >= 100]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert sum(r.predicted == int((r.doc_id - 100) % 4 == 0) for r in held) >= 0.95 * len(held)
    none = toxicity.score(documents(awkward), labels.where("false")).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.score(documents([]), labels).count() == 0


@needs_data
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= before
    assert docs.count() == corpus_pipeline.run(spark, DATA).count()


@needs_data
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_has_rows(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0
