import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import extract, html_blocks, vectors
from panelspark.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_links(ids, x, cosine):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return near.sum(1), label
        label = new


@pytest.mark.parametrize("leaf", [2000, 30])
def test_vectors(spark, monkeypatch, leaf):
    monkeypatch.setattr(vectors, "LEAF", leaf)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:80] + rng.normal(0, 0.12, (80, 16)), np.repeat(base[:1], 30, 0), base[:1] + rng.normal(0, 0.1, (60, 16))]).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 3), (904, [None, *[1.0] * 15])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    n, comp = brute_links(range(len(x)), x.astype(float), 0.9)
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(len(x))] == n.tolist()
    assert [got[i].component_id for i in range(len(x))] == comp.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_in_64_dimensions(spark, monkeypatch):
    """Planted copies at cosines around the bound: every link is found, none below it."""
    monkeypatch.setattr(vectors, "LEAF", 60)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 64))
    near = [base[i % 400] + rng.normal(0, s, 64) for s in (0.1, 0.3, 0.48, 0.5) for i in range(150)]
    crowd = base[7] + rng.normal(0, 0.3, (200, 64))
    x = np.concatenate([base, near, crowd])
    n, comp = brute_links(range(len(x)), x, 0.9)
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert n.sum() > 1000
    assert [got[i].n_links for i in range(len(x))] == n.tolist() and [got[i].component_id for i in range(len(x))] == comp.tolist()


def test_vectors_of_extreme_doubles_and_repeated_ids(spark):
    a = [1.0, 2.0, -3.0, 0.5]
    scaled = [(0, a), (1, [v * 1e-50 for v in a]), (2, [v * 1e39 for v in a]), (3, [v * 1e200 for v in a]), (4, [-v for v in a]), (5, [v * 1e-300 for v in a])]
    df = spark.createDataFrame(scaled + [(5, [v * 1e-300 for v in a]), (None, a)], "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("links", "weight", "key", "n_links", "block")})
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in vectors.near_duplicates(df).collect())
    assert got == [("0", 5, "0"), ("1", 5, "0"), ("2", 5, "0"), ("3", 5, "0"), ("4", 0, "4"), ("5", 5, "0"), ("5", 5, "0"), ("None", 0, "None")]


def shuffled(spark) -> int:
    """Bytes that all stages so far have written for shuffles."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("chain", [1 << 20, 40])
def test_vectors_travel_once(spark, monkeypatch, chain):
    """What is shuffled follows the number of vectors, not the number of leaves that they meet; crowds over several pages keep every link."""
    monkeypatch.setattr(vectors, "LEAF", 30)
    monkeypatch.setattr(vectors, "CHAIN", chain, raising=False)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 64))
    x[1000:] = x[3] + rng.normal(0, 0.3, (200, 64))
    df = spark.createDataFrame([(5000 - i, v.tolist()) for i, v in enumerate(x)] + [(9000 + i, x[1000].tolist()) for i in range(50)], "vec_id long, embedding array<float>")
    before = shuffled(spark)
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert shuffled(spark) - before < 4 * 1250 * 64 * 4
    every = np.concatenate([x, np.repeat(x[1000:1001], 50, 0)]).astype(np.float32).astype(float)
    ids = [*(5000 - np.arange(1200)).tolist(), *range(9000, 9050)]
    n, comp = brute_links(ids, every, 0.9)
    assert n.max() > 100
    assert [got[i].n_links for i in ids] == n.tolist() and [got[i].component_id for i in ids] == comp.tolist()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 60), (60, 80), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[100] == got[80] == 60


def test_components_with_stored_minima(spark, monkeypatch):
    """Nodes with thousands of links, tied to each other by one; and no links at all."""
    links = [(10_000, i) for i in range(100, 3000)] + [(50, i) for i in range(5000, 9000)] + [(2999, 8999)]
    want = {n: 50 for link in links for n in link}
    monkeypatch.setattr("panelspark.llm.components.MANY", 1000)
    for rows, classes in ((links, want), ([], {})):
        got = [tuple(r) for r in components(spark.createDataFrame(rows, "a long, b long")).collect()]
        assert dict(got) == classes and len(got) == len(classes)


def test_vectors_of_signed_zeros(spark):
    rows = [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [0.0, -0.0]), (4, []), (5, [1.0, float("-inf")])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True)}


PAGE = "<html><head><title>T</title><style>p{}</style></head><body><header><div class=logo>Site</div></header><nav><ul><li><a href=/>Home</a></ul></nav><script>var t='</p>';</script><article><h1>A &amp; B</h1><p><b>First   text of the\n story goes on here.<br><p>Second text, quite long, of the same story.</article><div class=ad>Buy now</div><section id=comments><p>Nice one.</p></section><footer>&copy; 2020</footer>"


#: Pages and their main text, labelled by hand.
LABELLED = [
    (
        "<body><div id='header'><a href='/'>My site</a></div><div class='menu'><ul><li><a href='/a'>One</a><li><a href='/b'>Two</a></ul></div><div class='content'><h1>On bread</h1><p class='meta'>By Jo Baker, 3 May</p><p>Flour, water and salt make a loaf, and time does the rest of the work.</p><ul><li>Mix the dough in the evening.</li><li>Bake it in the morning.</li></ul><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> as they say.</p></div><div class='sidebar'><div class='widget'><a href='/x'>Related: cakes</a></div></div><div id='comments'><div class='comment'>Lovely loaf, thanks for that!</div></div><div id='footer'>All rights reserved</div></body>",
        "On bread\nBy Jo Baker, 3 May\nFlour, water and salt make a loaf, and time does the rest of the work.\nMix the dough in the evening.\nBake it in the morning.\nEnergy is E=mc2 as they say.",
    ),
    (
        "<html><body><div class=cookie-notice>We use cookies on this site. <button>Fine</button></div><main><article><header><h1>River &lt;floods&gt; again</h1></header><p title=\"never closed>The river rose by two metres in the night, and the bridge was shut.</p><aside class=promo>Subscribe now for more stories!</aside><blockquote>It was the worst in thirty years, the mayor said.</blockquote><table><tr><td>Monday</td><td>2.1 m</td></tr></table><form><input name=q><label>Search this site</label></form></article></main><nav><a href=/p2>Next page</a></nav></body></html>",
        "River <floods> again\nThe river rose by two metres in the night, and the bridge was shut.\nIt was the worst in thirty years, the mayor said.\nMonday\n2.1 m",
    ),
]


def test_pages_labelled_by_hand(spark):
    net = extract.train(spark.read.parquet(f"{SF}/pages.parquet"))
    long = "<article>" + "".join(f"<p>Paragraph {i} of a very long page, which goes on.</p>" for i in range(3000)) + "</article><footer>The end of it, copyright</footer>"
    rows = [(i, "u", h) for i, (h, _) in enumerate(LABELLED)] + [(None, None, long)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "n_chars", "h")}), net).collect()}
    for i, (_, want) in enumerate(LABELLED):
        lines, right = got[i].split("\n"), want.split("\n")
        assert len(set(lines) & set(right)) >= 0.8 * len(right) and len(set(lines) - set(right)) <= 1, lines
    lines = got[None].split("\n")
    assert len(lines) >= 2990 and "copyright" not in lines[-1]


@pytest.mark.parametrize("page", ['<a "x ' * 150_000, "<a '\"> " * 150_000, "<div>x" * 50_000, "<div>" * 50_000 + "</b>" * 50_000 + "</p>" * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<script>" + "</script " * 100_000, "<" * 1_000_000, "<!--" * 200_000, "".join(f"<div class='{chr(97 + i % 26)}{'b' * (i % 50)}'>x" for i in range(50_000))])
def test_broken_pages_take_time_in_proportion(page):
    began = time.process_time()
    blocks = html_blocks.blocks(page)
    assert time.process_time() - began < 15 and all(len(b.names) <= html_blocks.MOST_NAMES for b in blocks)


def test_quotes_that_never_close():
    text = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert text("""<p title="a>b">one</p><p title='>'>two</p><p title="x>three</p><p>four""") == ["one", "two", "three", "four"]
    assert text("<p>1 < 2 and <3</p><![CDATA[ gone ]]><script>'</scrip>'</script x>kept<!-- to the end <p>no") == ["1 < 2 and <3", "kept"]


def test_a_page_header_before_an_article_with_its_own(spark):
    net = extract.train(spark.read.parquet(f"{SF}/pages.parquet"))
    story = "".join(f"<p>Sentence number {i} of the story, long enough to be a paragraph of its own.</p>" for i in range(6))
    page = f"<body><header><h2>Site name</h2></header><article><header><h1>The headline of the story</h1></header>{story}</article><footer><p>Copyright of the site</p></footer></body>"
    plain = f"<body><nav><a href=x>Home</a></nav><article><div class='headline'>The headline of the story</div>{story}</article></body>"
    got = {r.page_id: r.text.split("\n") for r in extract.extract(spark.createDataFrame([(1, "u", page), (2, "u", plain)], "page_id long, url string, html string"), net).collect()}
    assert "Site name" not in got[1] and len(got[1]) == 7 and "Home" not in got[2] and len(got[2]) == 7


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    net = extract.train(pages, max_pages=60)
    extra = spark.createDataFrame([(-1, "u", PAGE), (-2, None, None), (-3, "e", ""), (-3, "e", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract.extract(extra, net).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(-3, ""), (-3, ""), (-2, ""), (-1, "A & B\nFirst text of the story goes on here.\nSecond text, quite long, of the same story.")]
    assert all(r.n_chars == len(r.text) for r in got)
    wrong = total = 0
    rows = {r.page_id: r.text for r in extract.extract(pages, net).collect()}
    for r in pages.collect():
        want = "\n".join(b.text for b in html_blocks.blocks(r.html) if extract.is_content(b.names))
        wrong, total = wrong + (rows[r.page_id] != want), total + 1
    assert wrong <= 0.02 * total
    assert extract.extract(extra.limit(0), None).count() == 0 and extract.train(extra.limit(0)) is None


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "packing"]
    kept = cp.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    calm = cp.toxicity_filter(spark, kept, SF)
    assert calm.columns == docs.columns and calm.count() <= kept.count()
    single = cp.near_duplicates(spark, calm, SF)
    assert single.columns == docs.columns
    from .test_texts import brute_classes

    ids = {r.doc_id for r in single.select("doc_id").collect()}
    assert ids == {d for d, (_, c) in brute_classes(calm.collect()).items() if d == c}
    pieces = cp.packed(spark, single, SF).collect()
    assert {r.doc_id for r in pieces} == ids


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    """Null, empty, long, repeated rows and clashing columns: each stage keeps the table's own columns and values."""
    import corpus_pipeline as cp

    clashing = odd_docs.withColumns({c: F.lit("mine") for c in ("base_failed", "__text", "text_hash", "component_id", "row", "order")})
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, clashing, SF)
        assert kept.columns == clashing.columns, name
        rows = kept.collect()
        assert {(r.score, r.probability, r.text_hash) for r in rows} == {("clash", "clash", "mine")}, name
        assert stage(spark, no_docs, SF).count() == 0
        texts = [r.text for r in rows]
        if name == "quality rules":
            assert None not in texts and "" not in texts
        elif name == "toxicity":
            assert len([t for t in texts if not t]) == 2
        else:
            assert len([t for t in texts if not t]) == 2 and len([r for r in rows if r.doc_id == 8]) == 1
    pieces = cp.packed(spark, clashing, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in odd_docs.select("doc_id").collect()} and not cp.packed(spark, no_docs, SF).count()


def test_pipeline_keeps_every_text_of_repeated_ids(spark):
    import corpus_pipeline as cp

    a, b, c, d = (" ".join(f"{w}{i}" for i in range(60)) for w in "abcd")
    rows = [(3, a), (7, a), (7, b), (9, b), (7, c), (7, c), (8, d), (8, d + " more"), (None, a), (None, a), (5, None), (5, c), (5, c)]
    kept = cp.near_duplicates(spark, spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, text_hash string"), SF)
    assert kept.columns == ["doc_id", "text", "text_hash"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    eight = [x for x in got if x[0] == 8]
    assert len(eight) == 1 and eight[0][1] in (d, d + " more")
    assert [x for x in got if x[0] != 8] == sorted([(3, a), (7, b), (5, c), (None, a), (5, None)], key=str)
