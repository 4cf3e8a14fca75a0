"""Source lists, feeds and source expansion (A1, A3, A4, C4, A5)."""

import json

import pytest

from broadsheet.sources import feeds as FD

RSS = ("<rss version='2.0'><channel><title>f</title>"
       "<item><title>One</title><link>https://a/1</link><pubDate>Mon, 01 Jan 2024</pubDate></item>"
       "<item><title>No link</title></item>"
       "<item><link>https://a/3</link></item>"
       "<item><title>Four</title><link>https://a/4</link></item></channel></rss>")
ATOM = ("<feed xmlns='http://www.w3.org/2005/Atom'><title>f</title>"
        "<entry><title>E1</title><link href='https://b/1'/><updated>2024-01-02</updated></entry>"
        "<entry><title>E2</title><link href='https://b/2'/><published>2024-01-03</published></entry></feed>")
EMPTY = "<rss version='2.0'><channel><title>empty</title></channel></rss>"
BROKEN = "<rss><channel><title>oops"
BROKEN_WITH_ENTRY = "<rss><channel><item><title>t</title><link>https://f/1</link></item>"


@pytest.fixture
def feeds(spark):
    return spark.createDataFrame([("https://a/feed", RSS), ("https://b/atom.xml", ATOM),
                                  ("https://c/rss", EMPTY), ("https://d/feed", BROKEN),
                                  ("https://f/feed", BROKEN_WITH_ENTRY)], "feed_url string, xml string")


def test_feed_cases(spark, feeds):
    items = FD.feed_items(FD.parse_feeds(feeds)).collect()
    got = {(r.feed_url, r.pos): (r.title, r.link, r.published) for r in items}
    assert got == {("https://a/feed", 0): ("One", "https://a/1", "Mon, 01 Jan 2024"),
                   ("https://a/feed", 2): ("Untitled", "https://a/3", None),
                   ("https://a/feed", 3): ("Four", "https://a/4", None),
                   ("https://b/atom.xml", 0): ("E1", "https://b/1", "2024-01-02"),
                   ("https://b/atom.xml", 1): ("E2", "https://b/2", "2024-01-03"),
                   ("https://f/feed", 0): ("t", "https://f/1", None)}
    ok = {r.feed_url: r.ok for r in FD.parse_feeds(feeds).collect()}
    assert ok == {"https://a/feed": True, "https://b/atom.xml": True, "https://c/rss": True, "https://d/feed": False,
                  "https://f/feed": True}   # cut off, but its whole entries are read


def test_limits(spark, feeds):
    assert FD.feed_items(FD.parse_feeds(feeds), limit=0).count() == 0
    one = FD.feed_items(FD.parse_feeds(feeds), limit=1).collect()
    assert sorted((r.feed_url, r.link) for r in one) == [("https://a/feed", "https://a/1"), ("https://b/atom.xml", "https://b/1"),
                                                              ("https://f/feed", "https://f/1")]


def test_source_list_and_expansion(spark, feeds):
    lines = ["# comment", "", "   ", "https://a/feed", "  # indented comment is kept", "https://b/atom.xml",
             "https://c/rss", "https://d/feed", "https://e/article"]
    src = FD.source_lines(spark.createDataFrame(list(enumerate(lines)), "pos long, value string"))
    got = [r.source_url for r in src.orderBy("source_ord").collect()]
    assert got == ["https://a/feed", "# indented comment is kept", "https://b/atom.xml", "https://c/rss",
                   "https://d/feed", "https://e/article"]
    exp = FD.expand_sources(src, feeds).orderBy("ord").collect()
    urls = [(r.source_url, r.url) for r in exp]
    assert ("https://a/feed", "https://a/1") in urls and ("https://a/feed", "https://a/4") in urls
    assert ("https://d/feed", "https://d/feed") in urls          # unparsable feed -> itself
    assert not any(s == "https://c/rss" for s, _ in urls)        # empty feed -> nothing
    assert ("https://e/article", "https://e/article") in urls


def test_items_json(spark):
    docs = spark.createDataFrame([(1, json.dumps([{"title": "a", "url": "u"}, {"title": "b", "url": "v", "tags": ["x"]}])),
                                  (2, json.dumps({"title": "a", "url": "u"})), (3, json.dumps([{"title": "a"}]))],
                                 "k int, doc string")
    out = FD.parse_items_json(docs).collect()
    valid = {r.k: r.valid for r in out}
    assert valid == {1: True, 2: False, 3: False}
    assert [r.item.title for r in out if r.k == 1] == ["a", "b"]


RDF = ("<?xml version='1.0'?><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/' "
       "xmlns:dc='http://purl.org/dc/elements/1.1/'><channel><title>f</title></channel>"
       "<item><title>R1</title><link>https://r/1</link><dc:date>2024-01-05</dc:date></item></rdf:RDF>")
LINKS = ("<feed xmlns='http://www.w3.org/2005/Atom'>"
         "<entry><title>self first</title><link rel='self' href='https://x/self'/><link rel='alternate' href='https://x/page'/></entry>"
         "<entry><title>no rel</title><link rel='enclosure' href='https://x/file'/><link href='https://x/plain'/></entry>"
         "<entry><title>only self</title><link rel='self' href='https://x/only'/></entry><entry><title>cut")


def test_rdf_links_and_truncation(spark):
    df = spark.createDataFrame([("https://r/rdf", RDF), ("https://x/atom", LINKS)], "feed_url string, xml string")
    got = [(r.feed_url, r.title, r.link, r.published) for r in FD.feed_items(FD.parse_feeds(df)).orderBy("feed_url", "pos").collect()]
    assert got == [("https://r/rdf", "R1", "https://r/1", "2024-01-05"), ("https://x/atom", "self first", "https://x/page", None),
                   ("https://x/atom", "no rel", "https://x/plain", None), ("https://x/atom", "only self", "https://x/only", None)]


def test_repeated_feed_and_lines(spark, feeds):
    """A feed stored twice gives its entries once; a direct URL on two lines is manual on both."""
    from broadsheet.operators.extract import source_type
    src = FD.source_lines(spark.createDataFrame([(0, "https://a/feed"), (1, "https://e/x"), (1 << 40, "https://e/x")], "pos long, value string"))
    exp = FD.expand_sources(src, feeds.unionByName(feeds)).withColumn("t", source_type("n_entries"))
    assert sorted((r.source_ord, r.pos, r.url, r.t) for r in exp.collect()) == [
        (0, 0, "https://a/1", "rss"), (0, 2, "https://a/3", "rss"), (0, 3, "https://a/4", "rss"),
        (1, 0, "https://e/x", "manual"), (1 << 40, 0, "https://e/x", "manual")]


def test_source_list_of_many_partitions(spark):
    """Scan positions of any size are an order (partition 1100 starts beyond 2^43)."""
    src = FD.source_lines(spark.createDataFrame([((1100 << 33) + 5, "https://e/x"), (7, "https://e/y")], "pos long, value string"))
    none = spark.createDataFrame([], "feed_url string, xml string")
    assert [r.url for r in FD.expand_sources(src, none).orderBy("ord").collect()] == ["https://e/y", "https://e/x"]


def test_items_file_needs_an_array(spark):
    import uuid

    from broadsheet.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark) + f"/items-{uuid.uuid4().hex}"
    for name, text in (("good", '[{"title": "a", "url": "u"}]'), ("bad", '{"title": "a", "url": "u"}')):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{base}/{name}")
    assert FD.read_items_json(spark, f"{base}/good").count() == 1
    with pytest.raises(ValueError):
        FD.read_items_json(spark, f"{base}/bad")


def one_feed(spark, xml):
    p = FD.parse_feeds(spark.createDataFrame([("https://z/feed", xml)], "feed_url string, xml string"))
    return p.collect()[0].ok, [(r.pos, r.title, r.link, r.published) for r in FD.feed_items(p).orderBy("pos").collect()]


ITEM_A, ITEM_B = "<item><title>A</title><link>https://z/a</link></item>", "<item><title>B</title><link>https://z/b</link></item>"
GOOD = [(0, "A", "https://z/a", None), (1, "B", "https://z/b", None)]


@pytest.mark.parametrize("head", ["﻿", "<?xml version='1.0'?>\n<?xml-stylesheet href='x.xsl'?>", "<!DOCTYPE rss [<!ENTITY x 'y'>]>", "\n\n<!-- <item> -->",
                                  "<?xml version='1.0'?><!DOCTYPE rss PUBLIC '-//x//y' 'http://z/rss.dtd'>"])
def test_prologs(spark, head):
    assert one_feed(spark, f"{head}<rss version='2.0'><channel>{ITEM_A}{ITEM_B}</channel></rss>") == (True, GOOD)


@pytest.mark.parametrize("broken", ["<item><title>x<y</title><link>https://z/x</link></item>", "<item><title>x</title><link>https://z/x</item>",
                                    "<item><title>x</title><link>https://z/x</link>", "<item a=1><title>x</title></item>"])
def test_a_broken_entry_is_lost_alone(spark, broken):
    assert one_feed(spark, f"<rss><channel>{ITEM_A}{broken}{ITEM_B}</channel></rss>") == (True, GOOD)
    assert one_feed(spark, f"<rss><channel>{broken}</channel></rss>") == (False, [])


def test_references_in_entries(spark):
    xml = ("<rss><channel><item><title>R&D &amp; a&nbsp;b &eacute; &#233; &#xe9; &unknown; &lt;i&gt;</title><link>https://z/?a=1&b=2&copy=3</link></item>"
           "<item><title><![CDATA[<b>x</b> & </item> &amp;]]></title><link><![CDATA[https://z/c]]></link></item></channel></rss>")
    assert one_feed(spark, xml) == (True, [(0, "R&D & a b é é é &unknown; <i>", "https://z/?a=1&b=2&copy=3", None),
                                           (1, "<b>x</b> & </item> &amp;", "https://z/c", None)])


def test_prefixes_guids_and_nested_titles(spark):
    atom = ("<a:feed xmlns:a='http://www.w3.org/2005/Atom'><a:entry><a:source><a:title>no</a:title></a:source><a:title type='html'>T</a:title>"
            "<a:link rel='self' href='https://z/s'/><a:link href='https://z/t'/><a:updated>2024-01-02</a:updated></a:entry></a:feed>")
    assert one_feed(spark, atom) == (True, [(0, "T", "https://z/t", "2024-01-02")])
    rss = ("<rss xmlns:m='http://m'><channel><item><m:title>no</m:title><title>G</title><image><title>no</title><link>https://no</link></image>"
           "<guid>https://z/g</guid></item><item><guid isPermaLink='false'>id-7</guid></item>"
           "<item><guid isPermaLink='true'>https://z/h</guid><link>https://z/i</link></item></channel></rss>")
    assert one_feed(spark, rss) == (True, [(0, "G", "https://z/g", None), (2, "Untitled", "https://z/i", None)])


def test_malformed_and_empty_falls_back(spark):
    src = FD.source_lines(spark.createDataFrame([(0, "https://z/feed"), (1, "https://y/feed"), (2, "https://x/page"), (3, "https://w/feed")], "pos long, value string"))
    docs = spark.createDataFrame([("https://z/feed", "<rss><channel><title>a</channel></rss>"), ("https://y/feed", "<rss><channel></channel></rss>"),
                                  ("https://x/page", "<html><body><p>no feed</body></html>"), ("https://w/feed", None)], "feed_url string, xml string")
    assert [(r.source_ord, r.url) for r in FD.expand_sources(src, docs).orderBy("ord").collect()] == [
        (0, "https://z/feed"), (2, "https://x/page"), (3, "https://w/feed")]


def test_readable_copies_come_first(spark):
    docs = spark.createDataFrame([("https://z/feed", "<rss><channel><item>"), ("https://z/feed", f"<rss><channel>{ITEM_A}{ITEM_B}</channel></rss>"),
                                  ("https://z/feed", None)], "feed_url string, xml string")
    assert [(r.pos, r.title, r.link, r.published) for r in FD.feed_items(FD.parse_feeds(docs)).orderBy("pos").collect()] == GOOD


def test_feeds_are_parsed_once(spark, feeds):
    """One scan of the feeds, one parse of the entries (and one of documents without entries)."""
    plan = FD.expand_sources(FD.source_lines(spark.createDataFrame([(0, "https://a/feed")], "pos long, value string")), feeds)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_xml") + text.count("XmlToStructs") <= 2
