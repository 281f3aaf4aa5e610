"""Literal vectors of plans over many sources, units of text and EPUB files."""

import io
import zipfile

from pyspark.sql import functions as F

from foliospark.operators import units
from foliospark.plans import federated
from foliospark.sources import epub


def units_of(spark, text, most=10):
    return spark.createDataFrame([(text,)], "t string").select(units.units_of(F.col("t"), most).alias("u")).first().u


def test_units(spark):
    assert units_of(spark, " ab \n\n……\ncd") == ["ab", "cd"]
    assert units_of(spark, "一二三。四五六。七八九。") == ["一二三。四五六。", "七八九。"]
    assert units_of(spark, "a" * 25) == ["a" * 10, "a" * 10, "a" * 5]
    assert units_of(spark, "甲。" + "b" * 12 + "。丙。") == ["甲。", "b" * 10, "bb。丙。"]
    assert units_of(spark, "😀" * 10 + "a") == ["😀" * 10, "a"] and units_of(spark, None) == []


def test_federated(spark):
    sources = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "source_id string, host string").withColumn("pattern", F.lit('<a href="([^"]*)">(.*?)</a>'))
    pages = spark.createDataFrame([(1, "http://H1/x/", '<a href="1"><b>One</b></a><a href="2"> </a>'), (2, "http://h1/y", '<a href="javascript:1">one</a>'), (3, "http://h2/", "none")], "page_id long, url string, html string")
    rows, errors = federated.page_hits(sources, pages)
    assert sorted((r.source_id, r.title, r.url) for r in rows.collect()) == [("a", "One", "http://H1/x/1"), ("a", "one", None)]
    assert sorted(map(tuple, errors.collect())) == [("b", "NO_HITS"), ("c", "NO_PAGE")]
    assert [(r.title, r.hits) for r in federated.search(sources, pages, "one").collect()] == [("One", 2)]


def test_requests(spark):
    df = spark.createDataFrame([("a b", "")], "q string, p string")
    r = df.select(federated.request('http://h/s?q={{q}}&p={{p||1}}&z={{z}},{"method":"post","body":"x","headers":{"A":"1"}}', {"q": F.col("q"), "p": F.col("p")}).alias("r")).first().r
    assert (r.url, r.method, r.body, r.headers, r.retry) == ("http://h/s?q=a%20b&p=1&z={{z}}", "POST", "x", {"A": "1"}, 0)
    k = df.select(federated.explore_kinds(F.lit("a::/1&&b\n ::/x\nc::/2")).alias("k")).first().k
    assert [tuple(x) for x in k] == [("a", "/1"), ("b", None), ("c", "/2")]
    assert df.select(federated.paired(F.lit(" "), F.lit("x")).alias("p")).first().p == "x"


def test_trees(spark):
    entries = spark.createDataFrame([(1, 1, []), (1, 2, [1]), (1, 3, [1, 2]), (1, 4, [])], "book long, id long, path array<long>")
    live = entries.filter("id IN (1, 3)").select("book", "id")
    assert sorted(map(tuple, federated.pruned_tree(entries, live).collect())) == [(1, 1, None), (1, 3, 1)]


def book(nav=True):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", f'<package xmlns="o"><manifest><item id="a" href="a%20b.xhtml"/><item id="b" href="c.xhtml"/><item id="n" href="nav.xhtml" properties="{"nav" if nav else ""}"/><item id="x" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="gone"/></spine></package>')
        z.writestr("O/a b.xhtml", "<p>A</p>")
        z.writestr("O/c.xhtml", "<p>C</p>")
        z.writestr("O/nav.xhtml", '<html xmlns:e="e"><nav e:type="toc"><ol><li><a href="c.xhtml">C <b>1</b></a><ol><li><a href="a%20b.xhtml#x">A</a></li></ol></li></ol></nav></html>')
        z.writestr("O/t.ncx", '<ncx><navMap><navPoint><navLabel><text>N</text></navLabel><content src="c.xhtml"/></navPoint></navMap></ncx>')
    return data.getvalue()


def test_epub(spark, tmp_path):
    (tmp_path / "one.epub").write_bytes(book())
    (tmp_path / "two.epub").write_bytes(book(nav=False))
    (tmp_path / "bad.epub").write_bytes(b"PK\x03\x04")
    rows = {(r.path.rpartition("/")[2], r.kind, r.ord): r for r in epub.read(spark, str(tmp_path)).collect()}
    assert [(rows["one.epub", "document", i].href, rows["one.epub", "document", i].content) for i in range(2)] == [("O/c.xhtml", "<p>C</p>"), ("O/a b.xhtml", "<p>A</p>")]
    assert [(rows["one.epub", "navigation", i].title, rows["one.epub", "navigation", i].href, rows["one.epub", "navigation", i].depth) for i in range(2)] == [("C 1", "O/c.xhtml", 0), ("A", "O/a b.xhtml#x", 1)]
    assert rows["two.epub", "navigation", 0].title == "N" and rows["bad.epub", "error", 0].error and len(rows) == 8


def test_current_item_in_one_order(spark):
    """One shuffle and one sort for both sides; several positions of a group, holes, ties, none before."""
    from foliospark.operators import shelf

    items = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 3.0), ("a", 3, 5.0), ("a", 4, None), ("b", 7, 9.0), ("b", 8, 10.0)], "g string, ord int, start double")
    positions = spark.createDataFrame([("a", 4.0), ("a", 5.0), ("a", 1.0), ("a", None), ("b", 2.0), ("b", 99.0), ("c", 1.0)], "g string, pos double")
    out = shelf.current_item(positions, items, "g")
    expected = {("a", 4.0, 2), ("a", 5.0, 3), ("a", 1.0, 1), ("a", None, 1), ("b", 2.0, 7), ("b", 99.0, 8), ("c", 1.0, None)}
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") == 1 and "Join" not in plan and "Aggregate" not in plan
