"""Literal vectors of the smaller functions."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import more as fm


def one(spark, expression):
    return spark.range(1).select(expression.alias("r")).first().r


def test_texts(spark):
    assert one(spark, fm.unescaped(F.lit("&lt;a&#x41;&nosuch;&amp;"))) == "<aA&nosuch;&"
    assert one(spark, fm.guarded_replace(F.lit("a1b22"), r"(\d+)", "<$1>")) == "a<1>b<22>"
    with pytest.raises(Exception, match="(?i)timed out|timeout"):
        one(spark, fm.guarded_replace(F.lit("a" * 40 + "!"), r"^(a|aa|a?a)+$", ""))
    assert one(spark, fm.page_text(F.lit("中".encode("gbk")), F.lit("gbk"), F.lit(""))) == "中"
    assert one(spark, fm.page_text(F.lit(b'<meta charset="gbk">' + "中".encode("gbk")), F.lit(""), F.lit("text/html"))).endswith("中")
    assert one(spark, fm.page_text(F.lit("é".encode()), F.lit(""), F.lit("text/html; charset=utf-8"))) == "é"
    assert one(spark, fm.without_icons(F.lit("★ name"))) == "name" and one(spark, fm.without_icons(F.lit("★"))) == "★" and one(spark, fm.icon(F.lit("a★☆b"))) == "★☆"
    assert one(spark, fm.sheet_keyword(F.lit("t "), F.lit(None).cast("string"))) == "t"


def test_maps(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    assert one(spark, fm.merged_headers(m(A="1", B="2"), m(a="3"))) == {"b": "2", "a": "3"}
    assert one(spark, fm.put(m(a="1", b="2"), m(b="3", c=None))) == {"a": "1", "b": "3"}
    assert one(spark, fm.got("k", m(k=""), m(k="v"))) == "v" and one(spark, fm.got("x", m(k="v"))) is None
    assert one(spark, fm.without_nulls(F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b")))) == '{"a":1}'


def test_rest(spark):
    key = F.lit("0123456789abcdef")
    sent = F.base64(F.aes_encrypt(F.lit("secret"), key, F.lit("CBC"), F.lit("PKCS")))
    assert one(spark, fm.aes_text(sent, key)) == "secret" and one(spark, fm.aes_text(F.lit("AAAA"), key)) is None
    assert one(spark, fm.is_detail(F.lit("http://h/b/1"), F.lit(r"http://h/b/\d"))) and not one(spark, fm.is_detail(F.lit("http://h/b/12"), F.lit(r"http://h/b/\d"))) and not one(spark, fm.is_detail(F.lit("x"), F.lit("")))
    assert one(spark, fm.ratio_within(F.lit(15.0), F.lit(10.0), F.lit(10.0))) == 0.5 and one(spark, fm.ratio_within(F.lit(99.0), F.lit(10.0), F.lit(10.0))) == 1
    assert [one(spark, fm.paragraph_at(F.lit(r), F.lit(5))) for r in (0.0, 0.125, 0.5, 1.0)] == [0, 1, 2, 4] and one(spark, fm.ratio_of(F.lit(4), F.lit(5))) == 1
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "url string")
    assert tuple(fm.receipts(wanted, spark.createDataFrame([("a",), ("z",)], "url string")).first()) == (2, 1, 1, 1)


def test_attributes_below_and_validation(spark):
    from foliospark.operators import dom, registry
    from foliospark.sources import pages

    nodes = pages.nodes(spark.createDataFrame([(1, '<body><li><a href="/1">x</a><a href="/2">y</a></li><li href="/0"><a href="/3">z</a></li><li>none</li></body>')], "page_id long, html string"))
    got = lambda tag: [r.value for r in dom.attribute_or_below(nodes, dom.elements(nodes, tag), "href").orderBy("ord").collect()]
    assert got("li") == ["/1", "/0"] and got("body") == []
    rows = spark.createDataFrame([("a", "u", "text", "r"), (" ", None, "audio", "")], "name string, base_url string, type string, content_rule string")
    assert [r.missing for r in registry.validated(rows).collect()] == [[], ["name", "base_url", "type", "content_rule"]]
    cards = spark.createDataFrame([("c", "1|2"), ("d", "3")], "card string, signature string")
    assert [r.card for r in registry.hidden_cards(cards, cards.filter("card = 'c'")).collect()] == ["d"]
