"""Queries over many sources at once: search, contents, exploring, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binding import let
from ..functions.text import WHITE, url_option, without_option
from ..functions.values import absolute_url, uri_component
from ..operators import search as _search
from ..shared import written

#: Sources (of bounded size) up to this many are broadcast to the pages, so that a host of very many pages isn't shuffled.
BROADCAST_SOURCES = 10_000


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1))


def page_hits(sources: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits and errors of sources (source_id, host, pattern) over pages (page_id, url, html).

    A source's pattern gives a row for each match: address in group 1, title in group 2. Sources meet pages
    by host. A blank title drops a row. A source without pages or without a match is an error row.
    """
    p = pages.select("page_id", F.col("url").alias("page_url"), "html", host(F.col("url")).alias("host"))
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    met = p.join(F.broadcast(sources) if few else sources, "host")
    # one look at a page's html: whole matches, whose groups are taken one by one
    whole = F.regexp_extract_all(F.col("html"), F.col("pattern"), F.lit(0))
    matches = written(met.select("source_id", "page_id", "page_url", "pattern", F.posexplode_outer(whole).alias("ord", "m")))
    group = lambda g: F.get(F.regexp_extract_all(F.col("m"), F.col("pattern"), F.lit(g)), F.lit(0))
    rows = matches.filter("m IS NOT NULL").select("source_id", "page_id", "ord", F.btrim(F.regexp_replace(group(2), "<[^>]*>", "")).alias("title"), F.lit(None).cast("string").alias("author"), group(1).alias("u"), "page_url", F.lit(None).cast("string").alias("kind")).filter("title <> ''")
    rows = rows.select("source_id", "page_id", "ord", "title", "author", absolute_url(F.col("u"), F.col("page_url")).alias("url"), "kind", F.struct("page_id", "ord").alias("arrival"))
    counts = matches.groupBy("source_id").agg(F.count_if(F.btrim(F.regexp_replace(group(2), "<[^>]*>", "")) != "").alias("__hits"))
    errors = sources.select("source_id").join(counts, "source_id", "left").filter("coalesce(__hits, 0) = 0")
    return rows, errors.select("source_id", F.when(F.col("__hits").isNotNull(), "NO_HITS").otherwise("NO_PAGE").alias("code"))


def search(sources: DataFrame, pages: DataFrame, keyword: str, most: int = _search.BOOKS) -> DataFrame:
    """The best merged books of all sources for a keyword."""
    rows, _ = page_hits(sources, pages)
    return _search.top_books(_search.merge_books(_search.first_hits(rows), keyword), most)


def contents(entries: DataFrame) -> DataFrame:
    """Chapters (book, idx, name, url) of entries (book, page_url, ord, name, url): a missing address is the page's own.

    A book in which no entry has an address gets error NO_URL in every row. Addresses stand once, by first entry.
    """
    has = F.coalesce(F.btrim("url"), F.lit("")) != ""
    rows = entries.withColumn("__any", F.bool_or(has).over(Window.partitionBy("book"))).withColumn("url", F.when(has, F.col("url")).otherwise(F.col("page_url")))
    first = F.row_number().over(Window.partitionBy("book", "url").orderBy("ord"))
    rows = rows.withColumn("__n", first).filter((F.col("__n") == 1) | ~F.col("__any"))
    idx = F.row_number().over(Window.partitionBy("book").orderBy("ord")) - 1
    return rows.select("book", idx.cast("long").alias("idx"), "name", "url", F.when(~F.col("__any"), "NO_URL").alias("error"))


def distinct_over_pages(rows: DataFrame, key: Column) -> DataFrame:
    """The first row of each source and key over pages (source_id, page, ord), with whether more may follow.

    more: the last page brought something new, and there are less than ten.
    """
    kept = rows.withColumn("__key", key)
    kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy("source_id", "__key").orderBy("page", "ord"))).filter("__n = 1").drop("__n", "__key")
    last = rows.groupBy("source_id").agg(F.max("page").alias("__last"))
    new = kept.groupBy("source_id").agg(F.max("page").alias("__new"))
    more = last.join(new, "source_id").select("source_id", ((F.col("__new") == F.col("__last")) & (F.col("__last") < 10)).alias("more"))
    return kept.join(more, "source_id")


def explore_kinds(x: Column) -> Column:
    """Kinds of a list of title::url entries that line ends or && separate; entries without a title go, a missing address is null."""
    entries = F.filter(F.transform(F.split(x, r"&&|\n", -1), lambda e: F.btrim(e)), lambda e: e != "")
    kinds = F.transform(entries, lambda e: F.struct(F.btrim(F.substring_index(e, "::", 1)).alias("title"), F.nullif(F.btrim(F.when(F.instr(e, "::") > 0, F.substring(e, F.instr(e, "::") + 2, F.length(e))).otherwise("")), F.lit("")).alias("url")))
    return F.filter(kinds, lambda k: k["title"] != "")


def kinds_of(x: Column) -> Column:
    """kinds (title, url) and form of a source's declared kinds: JSON (an array of objects), a text of title::url entries, none (empty), or unknown.

    Only entries with a title and an address count, trimmed. Where entries are declared and none counts, or the JSON is no array,
    the form is unknown, so that a fault isn't taken for a source without kinds. Scripts are of form js, without kinds.
    """
    t = F.btrim(x, F.lit(WHITE))
    whole = lambda k: (k["title"] != "") & (k["url"] != "")
    of = lambda title, url: F.struct(F.coalesce(F.btrim(title, F.lit(WHITE)), F.lit("")).alias("title"), F.coalesce(F.btrim(url, F.lit(WHITE)), F.lit("")).alias("url"))
    entries = F.filter(F.transform(F.split(t, r"(?:&&|\n)+", -1), lambda e: F.split(e, "::", -1)), lambda p: F.size(p) > 1)
    of_text = F.filter(F.transform(entries, lambda p: of(p[0], p[1])), whole)
    listed = F.try_variant_get(F.try_parse_json(t), "$", "array<variant>")
    text_at = lambda e, name: F.when(F.schema_of_variant(F.try_variant_get(e, f"$.{name}", "variant")) == "STRING", F.try_variant_get(e, f"$.{name}", "string"))
    of_json = F.filter(F.transform(listed, lambda e: of(text_at(e, "title"), text_at(e, "url"))), whole)
    declared = F.when(F.coalesce(t, F.lit("")) == "", "empty").when(t.rlike(r"(?i)^(?:@js:|<js>)"), "js").when(t.rlike(r"^[\[{]"), "json").when(F.contains(t, F.lit("::")), "text").otherwise("unknown")
    none = F.array().cast("array<struct<title: string, url: string>>")

    def read(form: Column) -> Column:
        kinds = F.coalesce(F.when(form == "text", of_text).when(form == "json", of_json), none)
        fault = ((form == "text") & (F.size(kinds) == 0)) | ((form == "json") & (listed.isNull() | ((F.size(kinds) == 0) & (F.size(listed) > 0))))
        return F.struct(kinds.alias("kinds"), F.when(fault, "unknown").otherwise(form).alias("form"))

    return let(declared, read)


def declared_kinds(kinds: DataFrame) -> DataFrame:
    """source_id, titles: each source's distinct titles in order (source_id, ord, title)."""
    distinct = kinds.groupBy("source_id", "title").agg(F.min("ord").alias("ord"))
    return distinct.groupBy("source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "title"))), lambda k: k["title"]).alias("titles"))


def request(template: str, values: dict[str, Column]) -> Column:
    """url, method, headers, body, charset, retry of an address with {{name}} or {{name||default}} filled in, percent-encoded, and an option object after a comma.

    A default stands for a null or empty value; unknown names stay. Without a method it is GET, POST if there is a body.
    """
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*(?:\|\|(.*?))?\}\}", template):
        parts.append(F.lit(template[at : m.start()]))
        v = values.get(m[1])
        if v is None:
            parts.append(F.lit(m[0] if m[2] is None else m[2]))
        else:
            v = uri_component(v.cast("string"))
            parts.append(v if m[2] is None else F.when(F.coalesce(v, F.lit("")) == "", F.lit(m[2])).otherwise(v))
        at = m.end()
    full = F.concat(*parts, F.lit(template[at:]))
    o = F.from_json(url_option(full), "method string, headers map<string,string>, body string, charset string, retry int")
    method = F.upper(F.coalesce(o["method"], F.when(o["body"].isNotNull(), "POST").otherwise("GET")))
    return F.struct(F.btrim(without_option(full)).alias("url"), method.alias("method"), o["headers"].alias("headers"), o["body"].alias("body"), o["charset"].alias("charset"), F.coalesce(o["retry"], F.lit(0)).alias("retry"))


def paired(own: Column, other: Column) -> Column:
    """A rule, or that of its pair where it is missing."""
    return F.coalesce(F.nullif(F.btrim(own), F.lit("")), other)


def pruned_tree(entries: DataFrame, live: DataFrame) -> DataFrame:
    """Entries (book, id, path: ids above it from the top) whose target is live (book, id); others go and their children rise to the nearest one left.

    Returns book, id, parent (null at the top).
    """
    alive = live.select("book", "id").distinct()
    kept = entries.join(alive, ["book", "id"], "left_semi")
    above = kept.select("book", "id", F.posexplode("path").alias("at", "up"))
    found = above.join(alive.withColumnRenamed("id", "up"), ["book", "up"]).groupBy("book", "id").agg(F.max_by("up", "at").alias("parent"))
    return kept.select("book", "id").join(found, ["book", "id"], "left")
