"""Literal vectors of text and value functions."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as fx
from foliospark.functions import values as fv
from foliospark.operators import dom, tagged
from foliospark.plans import federated
from foliospark.sources import pages


def values(spark, column, xs, kind="string"):
    rows = spark.createDataFrame(list(enumerate(xs)), f"i int, x {kind}").select("i", column(F.col("x")).alias("v"))
    return [r.v for r in rows.orderBy("i").collect()]


def test_objects(spark):
    xs = ["{'a': \"it's\"}", '{"a": "it\'s"}', "{'a': 'b', \"c\": 1}", "[1]", "['x']", "oops", "{'a': ", "", None, "{}"]
    got = values(spark, lambda x: F.to_json(pages.json_object(x)), xs)
    assert got == ['{"a":"it\'s"}', '{"a":"it\'s"}', '{"a":"b","c":1}', None, None, None, None, None, None, "{}"]


def test_html_or_not(spark):
    yes = ["<section>", "a<blockquote>b", '<font color="red">', "<CODE>", "<p class=x id='y'>", "</figure>", "<br/>", "<img src=a hidden>", "<th\n>"]
    no = ["a < b", "<b 不是标签>", "<unknown>", "<bold>", "< p>", "&lt;p&gt;", "", "<p class=>"]
    assert values(spark, fx.looks_like_html, yes) == [True] * len(yes)
    assert values(spark, fx.looks_like_html, no) == [False] * len(no)


def test_entities(spark):
    xs = ["&#65;&#x41;&#00000000000065;&#x0000000000041;", "&amp;&lt;&nbsp;&hellip;&unknown;", "&#0;&#x110000;&#55296;&#99999999999999999999;", "a & b", None]
    assert values(spark, fx.content_decoded, xs) == ["AAAA", "&< …&unknown;", "&#0;&#x110000;&#55296;&#99999999999999999999;", "a & b", None]


@pytest.mark.parametrize("images", [False, True])
def test_page_text(spark, images):
    html = "<body>Buy<button>now</button><select><option>one</option></select><svg><text>icon</text></svg><figure>f<figcaption>c</figcaption></figure><textarea>t</textarea>a<span>b</span><noscript><img src='/i'></noscript>c</body>"
    nodes = pages.node_table(spark.createDataFrame([(1, html)], "page_id long, html string"))
    (row,) = dom.page_text(nodes, keep_images=images).collect()
    assert row.text == ("Buy\nf\nc\nab\n/i\nc" if images else "Buy\nf\nc\nabc")


def test_kinds(spark):
    xs = ['[{"title":" a ","url":"/1"},{},3]', "[]", "[{}]", "{}", "a::/1&&b::\n::/2\nc :: /3::x", "a::", "no", "", None, "@js:x", "<js>1</js>", "[1"]
    got = [(v["form"], [tuple(k) for k in v["kinds"]]) for v in values(spark, federated.kinds_of, xs)]
    assert got == [("json", [("a", "/1")]), ("json", []), ("unknown", []), ("unknown", []), ("text", [("a", "/1"), ("c", "/3")]), ("unknown", []), ("unknown", []), ("empty", []), ("empty", []), ("js", []), ("js", []), ("unknown", [])]


def test_interpolated(spark):
    names = F.create_map(F.lit("a"), F.lit("1"), F.lit("b.c"), F.lit("{{a}}"), F.lit("none"), F.lit(None).cast("string"))
    xs = ["{{a}}-{{ b.c }}{{none}}{{x}}", "plain", "", "{{a}", "{{a}}{{a}}", None]
    assert values(spark, lambda x: tagged.interpolated(x, names), xs) == ["1-{{a}}{{none}}{{x}}", "plain", "", "{{a}", "11", None]


def test_numbers(spark):
    assert values(spark, fv.whole_number, ["１２ 3", "-5", "二十一", "", " ", "x", None]) == [123, -5, 21, -1, -1, -1, None]
    assert values(spark, fv.numbered_title, ["第二十一章 x", "卷第３章第四章", "no", "第x章", ""]) == ["第21章 x", "卷第3章第四章", "no", "第-1章", ""]


def test_word_count_labels(spark):
    """Counts beyond a float's 24 bits are rounded to a float first."""
    xs = ["0", "10000", "12500", "16782501", "17115499", "18776501", "19109499", "x"]
    assert values(spark, fx.word_count_label, xs) == ["", "10000字", "1.2万字", "1678.2万字", "1711.6万字", "1877.6万字", "1911万字", "x"]
