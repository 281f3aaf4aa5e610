"""Literal vectors and brute-force versions of what SQL doesn't express."""

from collections import OrderedDict, defaultdict

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as fx
from foliospark.functions import values as fv
from foliospark.operators import dom, extract, paginate, registry, search, sequences, shelf, tagged
from foliospark.sources import pages as src
from foliospark.streaming import limits


def one(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values()) or (1,)], list(columns) or ["x"])
    return df.select(expression.alias("r")).first().r


def value(spark, expression):
    r = one(spark, expression)
    return r.kind, r.text if r.kind == "value" else r["items"] if r.kind == "list" else r["rows"] if r.kind == "matches" else None


A = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")


def test_combinators(spark):
    v, ls, none, empty = tagged.value(F.lit("a")), tagged.listed(A("b", "c")), tagged.miss(), tagged.listed(A())
    assert value(spark, tagged.first(none, empty, ls, v)) == ("list", ["b", "c"])
    assert value(spark, tagged.first(none, none)) == ("miss", None)
    assert value(spark, tagged.first(none, empty)) == ("list", [])
    assert value(spark, tagged.both(v, tagged.value(F.lit("b")))) == ("value", "a\nb")
    assert value(spark, tagged.both(v, ls, none)) == ("list", ["a", "b", "c"])
    assert value(spark, tagged.both(v, none, empty)) == ("value", "a")
    assert value(spark, tagged.both(none, empty)) == ("miss", None)
    m = tagged.matches(F.array(A("x", "y")))
    assert value(spark, tagged.both(none, m)) == ("matches", [["x", "y"]])
    with pytest.raises(Exception, match="matches"):
        value(spark, tagged.both(m, m))
    assert value(spark, tagged.interleaved(ls, tagged.listed(A("1", "2", "3")))) == ("list", ["b", "1", "c", "2"])
    assert value(spark, tagged.interleaved(empty, ls)) == ("list", ["b", "c"])
    assert value(spark, tagged.interleaved(empty, ls, as_list=True)) == ("miss", None)
    assert value(spark, tagged.reversed_(ls)) == ("list", ["c", "b"])
    assert value(spark, tagged.replaced(tagged.value(F.lit("a1b2")), r"(\d)", "<$1>")) == ("value", "a<1>b<2>")
    assert value(spark, tagged.replaced(tagged.value(F.lit("a1b2")), r"(\d)", "<$1>", once=True)) == ("value", "<1>")
    assert value(spark, tagged.replaced(tagged.value(F.lit("ab")), r"\d", "x", once=True)) == ("value", "")
    assert one(spark, tagged.text_of(ls)) == "b\nc" and one(spark, tagged.text_of(m)) == "y" and one(spark, tagged.url_of(ls)) == "b"
    assert value(spark, tagged.shaped(A("t"), F.lit(True))) == ("value", "t") and value(spark, tagged.shaped(A(), F.lit(True))) == ("list", [])


@pytest.mark.parametrize("spec,expected", [([0, 2], "AC"), ([-1, 10, 2], "DC"), ([7, 9], ""), ([(-1, 0)], "DCBA"), ([(1, 2)], "BC"), ([(0, 99, 2)], "AC"), ([3, (0, 3)], "DABC")])
def test_index(spark, spec, expected):
    got = value(spark, tagged.picked(A(*"ABCD"), spec))
    assert got == (("list", list(expected)) if expected else ("miss", None))


def test_index_after_exclusion(spark):
    assert value(spark, tagged.picked(A(*"ABCD"), [0], exclude=[0, -1])) == ("list", ["B"])
    assert value(spark, tagged.picked(A(*"AB"), None, exclude=[0, 1])) == ("miss", None)


def test_texts(spark):
    t = lambda f, x: one(spark, f(F.col("x")), x=x)
    assert t(fx.clean_text, "　a \t b\n c　") == "a b c"
    assert t(fx.chapter_text, "\n\n a \n\n\n b\n \n") == "a\n\nb"
    assert [t(fx.word_count_label, x) for x in ("8000", "10000", "10001", "12500", "13500", "0", "-3", "many")] == ["8000字", "10000字", "1万字", "1.2万字", "1.4万字", "", "", "many"]
    assert [t(fx.is_true, x) for x in ("", " null ", "FALSE", "no", "0.0", "1", "x")] == [False] * 5 + [True] * 2
    assert t(fx.groups, "a, b，c\\a,,") == ["a", "b", "c"]
    assert t(lambda x: fx.relevance_key(x, compose=True), "《Ｆｏｏ》 Bar!") == "foobar"
    assert t(fx.short_author, "x, y, z") == "x,y"
    assert t(fx.is_spoken, "…—— !") is False and t(fx.is_spoken, "ok.") is True
    page = lambda n: one(spark, fx.page_choice(F.lit("/l<a, b,c>.html"), F.lit(n).cast("int")))
    assert (page(1), page(2), page(9), page(None)) == ("/la.html", "/lb.html", "/lc.html", "/l<a, b,c>.html")
    assert t(fx.url_option, 'http://a/b , {"method":"POST"}') == '{"method":"POST"}' and t(fx.without_option, 'http://a/b,{"x":1}') == "http://a/b"
    assert t(fx.intro, " &nbsp;a<p class='x'>b<br>\n<!-- c --><b >d</b >") == "　　a\n　　b\n　　d"
    assert t(fx.intro, "") == "" and t(fx.intro, "　x　 \n\n y<i title='a'>z</i>") == "　　x\n　　yz" and t(fx.intro, "a&nbsp;&nbsp;b&zwnj;c") == "　　a bc" and len(t(fx.intro, "n" * 6000)) == 5000
    assert t(fx.content_decoded, "&lt;&#65;&#x4e2d;&nbsp;&hearts;&LDQUO;") == "<A中\u00a0&hearts;\u201c"
    assert t(fx.looks_like_html, "a <br> b") and not t(fx.looks_like_html, "1 < 2 <x>")


def test_values(spark):
    assert [fv.numeral(x) for x in ("十", "十二", "一百零三", "两千", "一千一", "一万二千", "三亿", "12", "")] == [10, 12, 103, 2000, 1100, 12000, 3 * 10**8, -1, 0]
    assert [fv.numeral(x) for x in ("一亿二千三百万零四", "三万亿", "二零二四", "万", "一千零五", "十五萬", "两百五")] == [123000004, 3 * 10**12, 2024, 0, 1005, 150000, 250]
    t = lambda f, x: one(spark, f(F.col("x")), x=x)
    assert t(fv.uri_component, "a b/é~'()") == "a%20b%2F%C3%A9~'()"
    assert t(fv.md5_middle, "a") == "c0f1b6a831c399e2" and t(fv.from_hex, "6162") == "ab" and t(fv.from_hex, "6g") == ""
    assert t(lambda x: fv.hmac_hex(x, "k"), "m") == __import__("hmac").new(b"k", b"m", "sha256").hexdigest()
    assert one(spark, fv.absolute_url(F.lit("../x"), F.lit("http://h/a/b/c"))) == "http://h/a/x" and one(spark, fv.absolute_url(F.lit("javascript:1"), F.lit("http://h"))) is None
    same = lambda a, b: one(spark, fv.same_chapter(F.lit(a), F.lit(b)))
    assert same("http://h/c/1_2.html", "http://h/c/1.html") and same("http://h/c/1.html?page=2", "http://h/c/1.html") and not same("http://h/c/1.html?cid=2", "http://h/c/1.html") and not same("http://g/c/1_2.html", "http://h/c/1.html") and not same("http://h/c/2.html", "http://h/c/1.html")
    assert t(fv.cookies, "a=1; b = x=y; bad; a=2") == {"a": "2", "b": "x=y"}
    canon = lambda u, b=None: one(spark, fv.canonical_url(F.lit(u), F.lit(b).cast("string")))
    assert canon('HTTP://H.Example:80/a b?q=é#f , {"x":1}') == "http://h.example/a%20b?q=%C3%A9#f" and canon("../c", "https://h/a/b/") == "https://h/a/c" and canon("https://h") == "https://h/" and canon("no address") == "no address"
    assert t(lambda x: fv.form_in_charset(x, "gbk"), "a=%E4%B8%AD%E6%96%87&b=%20&c=%FF") == "a=%D6%D0%CE%C4&b=%20&c=%FF"
    assert t(fv.safe_key, "é" * 60).count("~") == 1 and t(fv.format_time, 0) == "1970/01/01 00:00"


HTML = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>
<div id=list class="a b"><ul><li>A<li>B<b>x</b><li>C</ul><p>one<br>two<p>three <span>four</span></div>
<script>var t="</p>";</script><dl><dt>k</dt><dd>v1<dd>v2</dl><input value=q><a href="/1">l1</a><a href="/1">l2</a><a href="">l3</a>"""


@pytest.fixture(scope="module")
def nodes(spark):
    return src.nodes(spark.createDataFrame([(1, HTML), (2, None), (3, "plain & text")], "page_id long, html string")).cache()


def texts(df):
    return [r.text for r in df.orderBy("page_id", "node_id").collect()]


def test_tree(spark, nodes):
    li = dom.elements(nodes, "li")
    assert texts(dom.own_text(nodes, li)) == ["A", "B", "C"] and texts(dom.all_text(nodes, li)) == ["A", "Bx", "C"]
    assert texts(dom.text(nodes, dom.elements(nodes, "div", cls="b a"))) == ["A\nBx\nC\none\ntwo\nthree four"]
    assert "p{}" not in texts(dom.text(nodes, dom.elements(nodes, "html")))[0]
    assert texts(dom.own_text(nodes, dom.at(li, [0, -1]))) == ["A", "C"]
    assert texts(dom.own_text(nodes, dom.at(li, [0], exclude=[0]))) == ["B"] and dom.at(li, [9]).count() == 0
    assert texts(dom.own_text(nodes, dom.elements(nodes, "dd"))) == ["v1", "v2"]
    assert [r.value for r in dom.attribute(dom.elements(nodes, "a"), "href").collect()] == ["/1"]
    ul = dom.elements(nodes, "ul")
    assert dom.children(nodes, ul).count() == 3 and dom.children(nodes, ul, "b").count() == 0
    assert dom.within(dom.elements(nodes, "b"), ul).count() == 1 and dom.within(ul, ul).count() == 1 and dom.within(ul, ul, or_self=False).count() == 0
    assert texts(dom.own_text(nodes, dom.placed(li).filter("place = last - 1"))) == ["B"]
    nearest = dom.siblings(nodes, dom.at(li, [2]), following=False).filter("place = 1")
    assert texts(dom.own_text(nodes, nearest)) == ["B"]
    assert dom.parents(nodes, li).select("tag").distinct().collect()[0].tag == "ul"
    assert dom.containing(nodes, li, "bX").count() == 1 and dom.containing(nodes, li, "bx", own=True).count() == 0
    assert dom.elements(nodes, like={"class": "^a"}).count() == 1 and dom.elements(nodes, ident="list").count() == 1
    assert [r.text for r in dom.text_nodes(nodes, dom.at(li, [1])).orderBy("at").collect()] == ["B", "x"]
    assert nodes.filter("page_id = 3").select("text").first().text == "plain & text" and nodes.filter("page_id = 2").count() == 0


def test_html_again(spark):
    page = '<div id="a"><p title="x &amp; &quot;y&quot;">one &lt; two<br>three</p><script>if (a < b) {}</script><ul><li>A</li><li><b><i>B</i></b></li></ul></div>'
    tree = src.nodes(spark.createDataFrame([(1, page)], "page_id long, html string"))
    of = lambda tag, **k: [r.html for r in dom.html(tree, dom.elements(tree, tag), **k).orderBy("node_id").collect()]
    assert of("div") == [page] and of("div", inner=True) == [page[12:-6]] and of("li", inner=True) == ["A", "<b><i>B</i></b>"] and of("br") == ["<br>"]


def test_content(spark):
    rows = [(1, "<p>a<img data-x='no' data-echo='/e' src=''>b</p><script>x</script>"), (2, "plain &amp; &#x4e2d; 1 < 2"), (3, "&lt;p&gt;escaped&lt;/p&gt;&lt;p&gt;twice&lt;/p&gt;"), (4, None), (5, ""), (6, "<p></p>")]
    out = {r.k: r.text for r in dom.content_text(spark.createDataFrame(rows, "k long, c string"), "k", "c").collect()}
    assert out == {1: "a\n/e\nb", 2: "plain & 中 1 < 2", 3: "escaped\ntwice", 4: None, 5: "", 6: ""}
    again = {r.k: r.text for r in dom.content_text(spark.createDataFrame(list(out.items()), "k long, c string"), "k", "c").collect()}
    assert again == out


def test_json_forms(spark):
    j = F.lit('{"a":[1,2,3],"b":{"x":"s","y":null},"c":[{"n":1},{"m":2}]}')
    get = lambda *steps: one(spark, extract.json_steps(j, *steps))
    assert get("a", -1) == ["3"] and get("a", slice(1, None)) == ["2", "3"] and get("a", slice(-2, -1)) == ["2"] and get("a", 9) == [] and get("c", "*", "n") == ["1"]
    assert get("b", "*") == ['"s"', "null"] and get("a", "*") == ["1", "2", "3"] and get("zz", "*") == [] and one(spark, extract.json_steps(F.lit("{oops"), "a")) == []
    rows = spark.createDataFrame([(1, '{"n":{"n":[1]},"z":[{"n":"x"}]}'), (2, "7"), (3, "bad")], "k long, j string")
    assert sorted((r.k, r.at, r.value) for r in extract.json_below(rows, "k", "j", "n").collect()) == [(1, [0], '{"n":[1]}'), (1, [0, 0], "[1]"), (1, [1, 0, 0], '"x"')]


def test_plans_stay_small(spark):
    """Values mentioned often are in the plan once."""
    df = spark.createDataFrame([("a", ["b"])], "x string, y array<string>")
    v, w = tagged.value(F.upper("x")), tagged.listed(F.col("y"))
    out = df.select(tagged.text_of(tagged.replaced(tagged.reversed_(tagged.both(tagged.first(w, v), tagged.interleaved(w, v))), "b", "c")).alias("r"))
    assert out.first().r == "A\nc\nc" and out._jdf.queryExecution().optimizedPlan().toString().count("upper(") <= 4


def test_json_and_templates(spark):
    assert one(spark, extract.json_path(F.lit('{"a":{"b":[{"n":1},{"n":2}]}}'), "a.b[1].n")) == "2"
    assert one(spark, extract.json_path(F.lit('{"a":[{"n":1},{"n":2}]}'), "$.a[*].n")) == "[1,2]"
    for bad in ("$..n", "$.a[?(@.n)]", "$.a[-1]"):
        with pytest.raises(ValueError):
            extract.json_path(F.lit("{}"), bad)
    assert one(spark, extract.literal("/s?q={{q}}&{{other}}", {"q": F.lit("x")})) == "/s?q=x&{{other}}" and one(spark, extract.literal("{{q}}", {"q": F.lit(None)})) is None


def test_decoding(spark):
    rows = [("é".encode(),), (b"\xef\xbb\xbfa",), (b"\xff\xfe" + "中".encode("utf-16-le"),), (b"\xfe\xff" + "中".encode("utf-16-be"),), ("中文".encode("gbk"),), (None,)]
    got = [(r.d.text, r.d.encoding) for r in spark.createDataFrame(rows, "b binary").select(src.decoded("b").alias("d")).collect()]
    assert got == [("é", "utf-8"), ("a", "utf-8-bom"), ("中", "utf-16le"), ("中", "utf-16be"), ("中文", "gbk"), (None, None)]
    kinds = spark.createDataFrame([("a.epub", b"PK\x03\x04.."), ("a.epub", b"no"), ("a.PDF", b"%PDF"), ("a.txt", b"x")], "n string, c binary").select(src.container(F.col("n"), F.col("c")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["epub", "rejected", "rejected", "text"]


def test_import(spark):
    files = spark.createDataFrame([("a", '[{"n":1},{"n":2}]'), ("b", '{"n":3}'), ("c", "{oops"), ("d", "7")], "path string, value string")
    out = {(r.path, r.ord): (r.n, r.error) for r in src.import_sources(files).select("path", "ord", F.expr("variant_get(raw, '$.n', 'int')").alias("n"), "error").collect()}
    assert {k: v[0] for k, v in out.items()} == {("a", 0): 1, ("a", 1): 2, ("b", 0): 3, ("c", 0): None, ("d", 0): None} and out["c", 0][1] and out["d", 0][1]
    lenient = spark.createDataFrame([("{'a': 1}",), ("[1]",), ("x",)], "s string").select(src.json_object(F.col("s")).isNotNull().alias("r"))
    assert [r.r for r in lenient.collect()] == [True, False, False]


def test_chapters(spark):
    text = "preface\n第一章 甲\nbody\nmore\n第二章 乙\nend"
    rows = sequences.chapters(spark.createDataFrame([(1, text), (2, "no heading"), (3, "\n\nChapter 1\nx"), (4, None)], "doc_id long, text string")).orderBy("doc_id", "idx").collect()
    got = [(r.doc_id, r.name, ("" if r.doc_id == 4 else [text, "no heading", "\n\nChapter 1\nx"][r.doc_id - 1])[r.start : r.end]) for r in rows]
    assert got == [(1, "正文", "preface"), (1, "第一章 甲", "body\nmore"), (1, "第二章 乙", "end"), (2, "正文", "no heading"), (3, "Chapter 1", "x"), (4, "正文", "")]


def test_limiter(spark):
    assert one(spark, limits.rate_rule(F.lit("3/1000"))) == (3, 1000.0) and one(spark, limits.rate_rule(F.lit("1000"))) == (1, 1000.0)
    assert one(spark, limits.rate_rule(F.lit("0.5/1000"))) is None and one(spark, limits.rate_rule(F.lit("x"))) is None
    import random

    rng = random.Random(1)
    calls = [(k, i, rng.randint(0, 2000)) for k in range(3) for i in range(60)] + [(9, 0, 0), (9, 1, 0), (9, 2, 99)]
    out = {(r.k, r.i): (r.load, r.over) for r in limits.window_load(spark.createDataFrame(calls, "k long, i long, at long"), "k", "at", 2, 100).collect()}
    assert out[9, 0] == (2, False) and out[9, 2] == (3, True)
    for k, i, at in calls:
        n = sum(o == k and at - 100 < t <= at for o, _, t in calls)
        assert out[k, i] == (n, n > 2)


def test_stores(spark):
    import random

    rng = random.Random(2)
    reads = [(s, rng.randint(0, 6), i) for s in range(2) for i in range(80)]
    df = spark.createDataFrame(reads, "s long, k long, i long")
    out = {(r.s, r.i): r.gap for r in limits.reuse_distance(df, "s", "k", "i").collect()}
    for s in range(2):
        held = OrderedDict()
        for _, k, i in [r for r in reads if r[0] == s]:
            assert (out[s, i] is None) == (k not in held)
            if k in held:  # a store with room for gap + 1 keys has it, whatever was read between
                assert list(reversed(held)).index(k) <= out[s, i]
            held[k] = True
            held.move_to_end(k)
    rows = limits.lifetimes(df.withColumn("at", F.col("i") * 10), "k", "at", 30, "s").collect()
    last, life = {}, defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.k, r.at, r.s)):
        fresh = r.k not in last or r.at - last[r.k] >= 30
        life[r.k] += fresh
        last[r.k] = r.at
        assert (r.fresh, r.life) == (fresh, life[r.k])


def test_streams(spark, tmp_path):
    rows = [("a", t) for t in (0, 10, 20, 30)] + [("b", 5)]
    spark.createDataFrame(rows, "key string, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at long").parquet(str(tmp_path / "in"))
    q = limits.admitted_stream(stream, "key", "at", 2, 100).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.key, r.at, r.admitted) for r in spark.table("admitted").collect()) == [("a", 0, 0), ("a", 10, 10), ("a", 20, 100), ("a", 30, 110), ("b", 5, 5)]
    timed = stream.withColumn("ts", F.timestamp_millis("at"))
    q = limits.distinct_stream(timed, F.col("key"), "ts").writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.key for r in spark.table("firsts").collect()) == ["a", "b"]


def test_followed(spark):
    rows = [("p1", "p1", "p2", ["a", "b"]), ("p1", "p2", "p3", ["c", "d"]), ("p1", "p3", None, ["e", "f"]), ("l1", "l1", "l2", ["a"]), ("l1", "l2", "l3", ["a"]), ("z1", "z1", "z2", ["a"]), ("z1", "z2", "z3", []), ("c1", "c1", "n1", ["a"]), ("m1", "m1", "m2", ["a"]), ("m1", "m2", "m3", ["b"]), ("m1", "m3", "m4", ["c"]), ("m1", "m4", "m5", ["d"])]
    pages = spark.createDataFrame(rows, "start string, url string, next string, items array<string>")
    stop = spark.createDataFrame([("n1",)], "url string")
    out = {r.start: (r.stopped_by, r["items"], r.pages) for r in paginate.followed(pages, 4, stop).collect()}
    assert out == {"p1": ("end", list("abcdef"), 3), "l1": ("loop", ["a"], 2), "z1": ("zero-new", ["a"], 2), "c1": ("chapter-boundary", ["a"], 1), "m1": ("cap", list("abcd"), 4)}


def test_merge(spark):
    rows = [("s1", 0, "《甲》", "x", "/1", None), ("s2", 1, "甲", "X", "/2", None), ("s2", 2, "甲", None, "/3", None), ("s3", 3, "乙", "x", "/4", None)]
    hits = spark.createDataFrame(rows, "source_id string, arrival long, title string, author string, url string, kind string")
    out = {(r.title, r.author): (r.source_count, r.rank, r.hits) for r in search.merge_books(hits, "甲").collect()}
    assert out == {("《甲》", "x"): (2, 0, 2), ("甲", None): (1, 0, 1)}
    assert sorted((r.book, r.source_id) for r in search.book_hits(hits, "甲").collect()) == [(0, "s1"), (0, "s2"), (2, "s2")]
    wide = hits.withColumn("title", F.when(F.col("arrival") == 0, "Ｆｏｏ").otherwise("foo"))
    assert search.merge_books(wide.withColumn("author", F.lit("a")), "ｆｏｏ").count() == 1
    assert search.kept(hits, "").count() == 4 and search.kept(hits, "zz").count() == 0 and search.kept(hits, "甲 someone").count() == 3


def test_shelf_and_registry(spark):
    s = spark.createDataFrame([("a", None, 1, 5), ("b", "s", 9, 1), ("c", "s", 9, 2)], "book_key string, source_id string, updated_at long, added_at long").withColumn("progress", F.when(F.col("book_key") != "a", F.lit(0.5)))
    assert [r.book_key for r in shelf.shelf_sort(s).collect()] == ["c", "b", "a"]
    assert [s.filter(shelf.shelf_filter(k)).count() for k in ("all", "reading", "unread", "local")] == [3, 2, 1, 1]
    r = s.withColumn("source_id", F.col("book_key"))
    assert registry.chosen(r, [], True).count() == 3 and registry.chosen(r, [], False).count() == 0 and registry.chosen(r, ["a"], False).count() == 1
    filled = registry.backfill(s, spark.createDataFrame([("a", "z"), ("b", "z")], "book_key string, source_id string"), "book_key", "source_id")
    assert {x.book_key: x.source_id for x in filled.collect()} == {"a": "z", "b": "s", "c": "s"}
