"""Selections over pages as tables of nodes (sources.pages.nodes): joins on page and place, windows for positions.

A set of nodes is a table with page_id and node_id (and ctx, the node that a selection started from).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import BLOCK_TAGS, content_decoded, looks_like_html
from ..shared import written
from ..sources.pages import VOID, node_table

#: Elements whose text isn't shown, and those that begin and end lines.
_SKIPPED = tuple("script style noscript template iframe svg canvas audio video head title meta link base input button select textarea option".split())
_BREAKS = ("br", *BLOCK_TAGS)


def elements(nodes: DataFrame, tag: str | None = None, cls: str | None = None, ident: str | None = None, attr: dict[str, str] | None = None, like: dict[str, str] | None = None) -> DataFrame:
    """Elements by tag, by all words of a class, by id, by attributes' values or by regular expressions in them."""
    test = F.col("tag").isNotNull()
    if tag:
        test = test & (F.col("tag") == tag.lower())
    for word in (cls or "").replace(".", " ").split():
        test = test & F.array_contains(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), word)
    if ident:
        test = test & (F.col("attrs")["id"] == ident)
    for name, v in (attr or {}).items():
        test = test & (F.col("attrs")[name] == v)
    for name, pattern in (like or {}).items():
        test = test & F.col("attrs")[name].rlike(pattern)
    return nodes.filter(test)


def within(found: DataFrame, around: DataFrame, or_self: bool = True) -> DataFrame:
    """Of the found nodes those below (or equal to) one of the nodes around, each once.

    No node is paired with others: in document order, a node lies below one around if the furthest end
    of those before it reaches it.
    """
    a = around.select("page_id", F.col("node_id").alias("__at"), F.col("subtree_end").alias("__end"), F.lit(0 if or_self else 1).alias("__kind"))
    b = found.select("page_id", F.col("node_id").alias("__at"), F.lit(None).cast("int").alias("__end"), F.lit(0 if not or_self else 1).alias("__kind"))
    w = Window.partitionBy("page_id").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.union(b).withColumn("__reach", F.max("__end").over(w))
    kept = rows.filter(F.col("__end").isNull() & (F.col("__reach") >= F.col("__at"))).select("page_id", F.col("__at").alias("node_id"))
    return found.join(kept.distinct(), ["page_id", "node_id"], "left_semi")


def children(nodes: DataFrame, parents: DataFrame, tag: str | None = None) -> DataFrame:
    """Child elements of the parents, with ctx."""
    own = elements(nodes, tag)
    p = parents.select("page_id", F.col("node_id").alias("ctx")).distinct()
    return own.join(p, (own["page_id"] == p["page_id"]) & (own["parent_id"] == p["ctx"])).drop(p["page_id"])


def siblings(nodes: DataFrame, of: DataFrame, following: bool = True) -> DataFrame:
    """Sibling elements after (or before) each node, with ctx and place (1 is the nearest)."""
    o = of.select("page_id", F.col("node_id").alias("ctx"), F.col("parent_id").alias("__parent"), F.col("ord").alias("__ord"))
    own = elements(nodes)
    rows = own.join(o, (own["page_id"] == o["page_id"]) & (own["parent_id"] == o["__parent"])).drop(o["page_id"])
    rows = rows.filter(F.col("ord") > F.col("__ord") if following else F.col("ord") < F.col("__ord"))
    w = Window.partitionBy("page_id", "ctx").orderBy("ord" if following else F.desc("ord"))
    return rows.withColumn("place", F.row_number().over(w)).drop("__parent", "__ord")


def parents(nodes: DataFrame, of: DataFrame) -> DataFrame:
    up = of.select("page_id", F.col("parent_id").alias("node_id")).distinct()
    return nodes.join(up, ["page_id", "node_id"], "left_semi")


def placed(found: DataFrame, by: str = "parent_id") -> DataFrame:
    """Adds place (from 1) and last: a node's number among those found below one parent, and their number."""
    w = Window.partitionBy("page_id", by)
    return found.withColumn("place", F.row_number().over(w.orderBy("node_id"))).withColumn("last", F.count("*").over(w))


def at(found: DataFrame, spec: list[int] | None = None, exclude: list[int] | None = None) -> DataFrame:
    """Of each page's found nodes those at the listed places (0 is the first, -1 the last), after the excluded ones went."""

    def numbered(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("page_id")
        return df.withColumn("__n", F.row_number().over(w.orderBy("node_id")) - 1).withColumn("__k", F.count("*").over(w))

    def named(places: list[int]) -> Column:
        return F.col("__n").isin([p for p in places if p >= 0]) | (F.col("__n") - F.col("__k")).isin([p for p in places if p < 0])

    if exclude:
        found = numbered(found).filter(~named(exclude)).drop("__n", "__k")
    if spec is not None:
        found = numbered(found).filter(named(spec)).drop("__n", "__k")
    return found


def _parts(rows: DataFrame, of: DataFrame) -> DataFrame:
    """page_id, node_id (of a selected node), at, text: each part is given to the nodes on its path, which selected nodes meet by equality."""
    spread = rows.select("page_id", F.explode("path").alias("node_id"), "at", "text")
    return of.select("page_id", "node_id").distinct().join(spread, ["page_id", "node_id"])


def _texts(nodes: DataFrame, of: DataFrame, own: bool) -> DataFrame:
    """Text nodes below, or directly in, each selected node."""
    texts = nodes.filter("tag IS NULL").withColumnRenamed("node_id", "at")
    if own:
        texts = texts.withColumn("path", F.slice("path", -1, 1))
    return _parts(texts.filter(F.size("path") > 0), of)


def _gathered(rows: DataFrame, separator: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("at", "text")))
    return rows.groupBy("page_id", "node_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text"))


def clean_lines(x: Column) -> Column:
    """Blanks in a line made one, lines trimmed, empty ones dropped."""
    lines = F.transform(F.split(x, "\n", -1), lambda s: F.btrim(F.regexp_replace(s, r"[ \t\r\f 　]+", " ")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def own_text(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """page_id, node_id, text: text directly in each node, cleaned to one line."""
    rows = _gathered(_texts(nodes, of, own=True), "")
    return rows.withColumn("text", F.btrim(F.regexp_replace("text", r"\s+", " ")))


def all_text(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Text below each node, scripts included, cleaned to one line."""
    rows = _gathered(_texts(nodes, of, own=False), "")
    return rows.withColumn("text", F.btrim(F.regexp_replace("text", r"\s+", " ")))


#: Attributes that may hold an image's address, in order; any other data attribute comes after them.
IMAGE_ADDRESSES = ("src", "data-src", "data-original", "data-echo", "data-url", "data-page-image-url")


def _shown(nodes: DataFrame, keep_images: bool) -> DataFrame:
    """page_id, at, text, path: what is shown of pages, in parts: texts without scripts and styles, line ends of blocks, images' addresses on lines of their own."""
    # images that are loaded late stand in a noscript
    skipped = [x for x in _SKIPPED if not (keep_images and x == "noscript")]
    hidden = nodes.filter(F.col("tag").isin(*skipped)).select("page_id", "node_id", "subtree_end")
    gone = within(nodes, hidden).select("page_id", F.col("node_id").alias("at")).distinct()
    texts = nodes.filter("tag IS NULL").select("page_id", F.col("node_id").alias("at"), F.regexp_replace("text", r"\s+", " ").alias("text"), "path").join(gone, ["page_id", "at"], "left_anti")
    breaks = nodes.filter(F.col("tag").isin(*_BREAKS, *["noscript"] * keep_images))
    line = F.lit("\n").alias("text")
    marks = breaks.select("page_id", F.col("node_id").cast("double").alias("at"), line, "path").union(breaks.select("page_id", (F.col("subtree_end") + 0.5).cast("double").alias("at"), line, "path"))
    parts = texts.select("page_id", F.col("at").cast("double").alias("at"), "text", "path").union(marks)
    if keep_images:
        data = F.map_filter("attrs", lambda k, v: F.startswith(k, F.lit("data-")) & (v != ""))
        url = F.coalesce(*[F.nullif(F.col("attrs")[a], F.lit("")) for a in IMAGE_ADDRESSES], F.get(F.map_values(data), F.lit(0)))
        images = nodes.filter("tag = 'img'").select("page_id", F.col("node_id").cast("double").alias("at"), F.concat(F.lit("\n"), url, F.lit("\n")).alias("text"), "path")
        parts = parts.union(images.filter("text IS NOT NULL"))
    return parts


def text(nodes: DataFrame, of: DataFrame, keep_images: bool = False) -> DataFrame:
    """Text below each node without scripts and styles; block elements and <br> begin and end lines. Images are lines with their addresses, if they are to be kept."""
    return _gathered(_parts(_shown(nodes, keep_images), of), "").withColumn("text", clean_lines(F.col("text")))


def page_text(nodes: DataFrame, keep_images: bool = False) -> DataFrame:
    """page_id, text: the text of whole pages."""
    parts = F.sort_array(F.collect_list(F.struct("at", "text")))
    rows = _shown(nodes, keep_images).groupBy("page_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    return rows.withColumn("text", clean_lines(F.col("text")))


def content_text(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, text of contents that may be HTML, escaped HTML or plain: HTML as text with images' addresses, plain with its entities decoded.

    Doing it again changes nothing but blanks. Null content is null.
    """
    decoded = F.when(looks_like_html(F.col(content)), F.col(content)).otherwise(content_decoded(content))
    once = written(rows.select(F.col(key).cast("long").alias("page_id"), decoded.alias("html")).withColumn("tree", F.coalesce(looks_like_html(F.col("html")), F.lit(False))))
    trees = once.filter("tree")
    shown = trees.select("page_id").join(page_text(node_table(trees), keep_images=True), "page_id", "left")
    plain = once.filter("NOT tree").select("page_id", F.col("html").alias("text"))
    return plain.union(shown.select("page_id", F.coalesce("text", F.lit("")))).withColumnRenamed("page_id", key)


def html(nodes: DataFrame, of: DataFrame, inner: bool = False) -> DataFrame:
    """page_id, node_id, html: each node and what is below (inner: only that) as HTML again."""
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    quoted = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    elements_ = nodes.filter("tag IS NOT NULL")
    path = F.col("path") if inner else F.array_append("path", F.col("node_id"))
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), quoted(e["value"]), F.lit('"'))), "")
    place = lambda at, end, tie: F.struct(F.col(at).alias("at"), F.lit(end).alias("end"), tie.alias("tie")).alias("at")
    opened = elements_.select("page_id", place("node_id", 0, F.lit(0)), F.concat(F.lit("<"), "tag", attrs, F.lit(">")).alias("text"), path.alias("path"))
    # of ends at one place the inner element's comes first
    closed = elements_.filter(~F.col("tag").isin(*VOID)).select("page_id", place("subtree_end", 1, -F.col("node_id")), F.concat(F.lit("</"), "tag", F.lit(">")).alias("text"), path.alias("path"))
    raw = elements_.filter(F.col("tag").isin("script", "style")).select("page_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("raw"))
    texts = nodes.filter("tag IS NULL").join(raw, ["page_id", "parent_id"], "left")
    texts = texts.select("page_id", place("node_id", 0, F.lit(0)), F.when(F.col("raw"), F.col("text")).otherwise(escaped(F.col("text"))).alias("text"), "path")
    return _gathered(_parts(opened.union(closed).union(texts), of), "").withColumnRenamed("text", "html")


def text_nodes(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """page_id, node_id, at, text: each text node below, cleaned, blank ones dropped."""
    rows = _texts(nodes, of, own=False).withColumn("text", F.btrim(F.regexp_replace("text", r"\s+", " ")))
    return rows.filter("text <> ''").select("page_id", "node_id", "at", "text")


def attribute(found: DataFrame, name: str) -> DataFrame:
    """page_id, ord, value: the nodes' own attribute, empty ones dropped, each value of a page once, in document order."""
    rows = found.select("page_id", "node_id", F.btrim(F.col("attrs")[name]).alias("value")).filter("value <> ''")
    first = rows.groupBy("page_id", "value").agg(F.min("node_id").alias("at"))
    w = Window.partitionBy("page_id").orderBy("at")
    return first.select("page_id", (F.row_number().over(w) - 1).cast("long").alias("ord"), "value")


def containing(nodes: DataFrame, of: DataFrame, words: str, own: bool = False) -> DataFrame:
    """Of the nodes those whose text (or own text) contains the words, in any case."""
    texts = own_text(nodes, of) if own else all_text(nodes, of)
    hit = texts.filter(F.contains(F.lower("text"), F.lit(words.lower()))).select("page_id", "node_id")
    return of.join(hit, ["page_id", "node_id"], "left_semi")


def attribute_or_below(nodes: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """page_id, ord, value: each node's own attribute, or that of the first element below that has it (not for html and body).

    Empty values are dropped, each value of a page stands once, in document order of the selected nodes.
    """
    has = nodes.select("page_id", F.col("node_id").alias("at"), "path", F.btrim(F.col("attrs")[name]).alias("value")).filter("value <> ''")
    below = has.select("page_id", F.explode("path").alias("node_id"), "at", "value").groupBy("page_id", "node_id").agg(F.min_by("value", "at").alias("below"))
    rows = found.select("page_id", "node_id", "tag", F.nullif(F.btrim(F.col("attrs")[name]), F.lit("")).alias("own")).join(below, ["page_id", "node_id"], "left")
    value = F.coalesce("own", F.when(~F.coalesce("tag", F.lit("")).isin("html", "body"), F.col("below")))
    rows = rows.select("page_id", "node_id", value.alias("value")).filter("value IS NOT NULL")
    first = rows.groupBy("page_id", "value").agg(F.min("node_id").alias("at"))
    return first.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1).cast("long").alias("ord"), "value")
