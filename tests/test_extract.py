"""Page metadata and main text (B1-B3, B5), both extraction paths."""

from pyspark.sql import functions as F

from broadsheet.functions import html as H
from broadsheet.operators import pages as P


def _extract(spark, pages):
    df = spark.createDataFrame([(i, f"https://x.com/{i}", h) for i, h in enumerate(pages)],
                               "ord long, url string, html string")
    return {r.ord: r for r in P.extract_pages(df).collect()}


def test_sample_page(spark, sample_html):
    r = _extract(spark, [sample_html])[0]
    assert r.title == "Test Article Title"
    assert r.author == "John Doe"
    assert r.published_date == "2024-01-15"
    assert "Main Article Heading" in r.text and "first paragraph" in r.text and "third paragraph" in r.text
    assert "Navigation" not in r.text and "Footer content" not in r.text
    assert r.word_count == len(r.text.split())


def test_edge_pages(spark):
    pages = ["<html><body><p>Just a paragraph.</p></body></html>",
             "<p>Bare paragraph only</p>",
             "<html><body><script>var x = 1;</script><style>.a{}</style><p>Visible text</p></body></html>",
             ""]
    out = _extract(spark, pages)
    assert out[0].title == "Untitled" and out[0].author is None and out[0].published_date is None
    assert out[0].text == "Just a paragraph."
    assert out[1].text == "Bare paragraph only"
    assert out[2].text == "Visible text"
    assert out[3].text == "" and out[3].word_count == 0 and out[3].title == "Untitled"


META = [
    ('<title>T</title><meta property="og:title" content="OG">', "OG", None, None),
    ('<meta content="OG2" property="og:title"><title>T</title>', "OG2", None, None),
    ("<meta property='og:title' content='Single'><title>T</title>", "Single", None, None),
    ('<meta property="og:title" content=""><title> T2 </title>', "T2", None, None),
    ('<meta name="author" content="A"><meta property="article:author" content="B">', None, "B", None),
    ('<meta name="author" content="A">', None, "A", None),
    ('<meta name="date" content="2024-01-02"><meta property="article:published_time" content="2024-01-01">',
     None, None, "2024-01-01"),
    ('<meta name="date" content="2024-01-02">', None, None, "2024-01-02"),
    ('<meta property="article:published_time" content="  "><meta name="date" content="d2">', None, None, "d2"),
    ('<meta property="OG:TITLE" content="case"><title>T3</title>', "T3", None, None),
    ("<title>It&#8217;s &mdash; ok &#x1F600; &amp;lt; &lt;</title>", "It\u2019s \u2014 ok \U0001f600 &lt; <", None, None),
    ("<!-- <title>hidden</title> --><title>shown</title>", "shown", None, None),
    ("<script>var t = '<title>no</title>';</script><title>yes</title>", "yes", None, None),
    ("<title-bar>no</title-bar><title>T&bogus;&#xD800;</title>", "T&bogus;&#xD800;", None, None),
    ('<meta name="author" content="J&eacute;r&ocirc;me"><title>x</title>', "x", "J\u00e9r\u00f4me", None),
]


def test_meta_cases(spark):
    df = spark.createDataFrame([(i, m[0]) for i, m in enumerate(META)], "i int, html string")
    out = H.with_page_meta(df, "html", "t", "a", "d").collect()
    for r in out:
        _, t, a, d = META[r.i]
        assert (r.t, r.a, r.d) == (t, a, d), META[r.i][0]


CONTAINERS = [
    ("<body><nav>N</nav><article><p>In article</p></article><p>outside</p></body>", "In article"),
    ("<body><main><p>In main</p></main><p>outside</p></body>", "In main"),
    ('<body><div class="x content y"><p>In class</p></div><p>outside</p></body>', "In class"),
    ('<body><div id="content"><p>In id</p></div><p>outside</p></body>', "In id"),
    ("<body><p>Body only</p></body>", "Body only"),
    ("<p>Fragment only</p>", "Fragment only"),
    ("<body><article><p>Outer</p><article><p>Inner</p></article><p>tail</p></article></body>", "Outer Inner tail"),
    ("<body><article><nav>skip</nav><p>kept &amp; shown &copy;</p></article></body>", "kept & shown ©"),
    ("<body><article><p>a &eacute; b</p></article></body>", "a é b"),
    ("<body><!-- <article>no</article> --><p>x</p></body>", "x"),
    ("<body><main-content><p>custom element</p></main-content></body>", "custom element"),
    ("<body><article-card>card</article-card><header-bar>bar</header-bar></body>", "card bar"),
    ('<body><a title="a > b">link</a></body>', "link"),
    ("<body><aside><article>side</article></aside><div class='content'>kept</div><p>out</p></body>", "kept"),
    ("<body>" + "<p>" * 3000 + "deep", "deep"),
]


def test_container_cases(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CONTAINERS)], "ord long, html string")
    out = {r.ord: r.text for r in P.with_main_text(df, "html", "text").collect()}
    for i, (_, want) in enumerate(CONTAINERS):
        assert out[i] == want, CONTAINERS[i][0]


def test_regex_path_equals_parser_path(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(F.col("page_id").alias("ord"), "html")
    fast = pages.select("ord", H.regex_safe(F.col("html")).alias("safe"), "html")
    rows = fast.collect()
    assert sum(r.safe for r in rows) > 0.9 * len(rows)
    txt = {r.ord: r.text for r in P.with_main_text(pages, "html", "text").collect()}
    for r in rows:
        assert P.parse_main_text(r.html) == txt[r.ord]


def test_both_paths_are_taken_and_agree(spark):
    """The cases above split over both paths; the fast ones equal the parser's text."""
    pages = [c[0] for c in CONTAINERS]
    df = spark.createDataFrame(list(enumerate(pages)), "ord long, html string")
    safe = {r.ord: r.safe for r in df.select("ord", H.regex_safe(F.col("html")).alias("safe")).collect()}
    assert set(safe.values()) == {True, False}
    out = {r.ord: r.text for r in P.with_main_text(df, "html", "text").collect()}
    assert all(P.parse_main_text(pages[i]) == t for i, t in out.items())


def test_metadata_expressions_stand_once(spark):
    """Each tag's pattern is one expression of the executed plan."""
    pages = spark.createDataFrame([(1, "<title>x</title>")], "ord long, html string")
    plan = P.extract_pages(pages).select("ord", "title", "author", "published_date", "text", "word_count")
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert physical.count("og:title") == physical.count("article:published_time") == 3  # one pattern names it in three quotings


def test_structural_tags_are_collected_once(spark):
    df = spark.createDataFrame([("<body><p>x</p></body>",)], "html string")
    plan = P.with_main_text(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
