"""Further queries: decoding, JSON forms, tree projections, addresses, digests, small functions. Same registry as catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _t, query, rule_sources
from .catalog import _SOURCES as SOURCES
from .functions import more
from .functions import text as fx
from .functions import values as fv
from .operators import dom, extract, registry, sequences, tagged
from .plans import federated
from .shared import written
from .sources import pages as sources_pages
from .streaming import limits

# --- sources


@query("""SELECT doc_id, sha256(text) AS sha, CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16le' ELSE 'utf-8-bom' END AS encoding, sha256(text) AS declared_sha FROM documents""")
def decoded_texts(spark, d):
    """SC2, SC3, F40: texts in several encodings, read by their marks, and by a declared character set."""
    i, text = F.col("doc_id") % 3, F.col("text")
    marked = F.when(i == 0, F.encode(text, "UTF-8")).when(i == 1, F.concat(F.lit(b"\xff\xfe"), F.encode(text, "UTF-16LE"))).otherwise(F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(text, "UTF-8")))
    declared = more.page_text(F.encode(text, "UTF-16BE"), F.lit("UTF-16BE"), F.lit("text/html; charset=utf-8"))
    rows = _t(spark, d, "documents").select("doc_id", sources_pages.decoded(marked).alias("d"), F.sha2(declared, 256).alias("declared_sha"))
    return rows.select("doc_id", F.sha2("d.text", 256).alias("sha"), F.col("d.encoding").alias("encoding"), "declared_sha")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'epub' WHEN p_size % 4 IN (1, 2) THEN 'rejected' ELSE 'text' END AS kind FROM part""")
def containers(spark, d):
    """SC8: what files hold, by first bytes and names."""
    k = F.col("p_size") % 4
    name = F.concat("p_name", F.when(k == 1, ".EPUB").when(k == 2, ".pdf").otherwise(".txt"))
    content = F.when(k == 0, F.lit(b"PK\x03\x04..")).otherwise(F.encode("p_name", "UTF-8"))
    return _t(spark, d, "part").select("p_partkey", sources_pages.container(name, content).alias("kind"))


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN json_extract_string(props, '$.k')::INT END AS k FROM events""")
def lenient_json(spark, d):
    """SC6: objects of JSON, also with single quotes; an array is none."""
    x = F.when(F.col("event_id") % 5 == 4, F.concat(F.lit("["), "props", F.lit("]"))).when(F.col("event_id") % 2 == 0, F.translate("props", '"', "'")).otherwise(F.col("props"))
    return _t(spark, d, "events").select("event_id", F.try_variant_get(sources_pages.json_object(x), "$.k", "int").alias("k"))


@query("""SELECT 'f' || c_custkey AS path, i::INT AS ord, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey + i END AS n, c_custkey % 7 = 0 AS failed
FROM (SELECT c_custkey, unnest(range(CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 2 = 0 THEN 3 ELSE 1 END)) AS i FROM customer)""")
def imported_sources(spark, d):
    """SC9: sources of whole files: an object, an array of them, or a row with an error."""
    k = F.col("c_custkey")
    one = lambda j: F.concat(F.lit('{"n":'), (k + j).cast("string"), F.lit("}"))
    value = F.when(k % 7 == 0, "{oops").when(k % 2 == 0, F.concat(F.lit("["), one(0), F.lit(","), one(1), F.lit(","), one(2), F.lit("]"))).otherwise(one(0))
    files = _t(spark, d, "customer").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), value.alias("value"))
    return sources_pages.import_sources(files).select("path", "ord", F.try_variant_get("raw", "$.n", "long").alias("n"), F.col("error").isNotNull().alias("failed"))


# --- JSON


@query("""SELECT c_custkey, [(c_custkey + 2)::VARCHAR] AS last, [c_custkey::VARCHAR, (c_custkey + 1)::VARCHAR] AS some, [c_custkey::VARCHAR, '"s"'] AS all_values,
 CASE WHEN c_custkey % 2 = 0 THEN ['1', '2'] ELSE [] END AS names FROM customer""")
def json_forms(spark, d):
    """Negative indexes, slices, all values, names below all items."""
    k = F.col("c_custkey")
    json = F.to_json(F.struct(F.array(k, k + 1, k + 2).alias("a"), F.struct(k.alias("x"), F.lit("s").alias("y")).alias("b"), F.when(k % 2 == 0, F.array(F.struct(F.lit(1).alias("n")), F.struct(F.lit(2).alias("n")))).alias("c")))
    c = _t(spark, d, "customer").select("c_custkey", json.alias("j"))
    get = lambda *steps: extract.json_steps(F.col("j"), *steps)
    return c.select("c_custkey", get("a", -1).alias("last"), get("a", slice(0, -1)).alias("some"), get("b", "*").alias("all_values"), get("c", "*", "n").alias("names"))


@query("""SELECT event_id, len(p)::INT AS depth, v FROM (SELECT event_id, unnest([{'p': [0], 'v': k}, {'p': [1, 0, 0], 'v': '{"k":' || k || '}'}, {'p': [1, 0, 0, 0], 'v': k}]) AS e FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)) t, LATERAL (SELECT e.p AS p, e.v AS v)""")
def json_below(spark, d):
    """Everything of a name, at any depth."""
    k = F.get_json_object("props", "$.k")
    j = F.concat(F.lit('{"k":'), k, F.lit(',"m":[{"k":{"k":'), k, F.lit("}}]}"))
    found = extract.json_below(_t(spark, d, "events").select("event_id", j.alias("j")), "event_id", "j", "k")
    return found.select("event_id", F.size("at").alias("depth"), F.col("value").alias("v"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' ELSE '{"key":' || o_orderkey || '}' END AS row_json FROM orders""")
def tool_rows(spark, d):
    """SK5: rows as JSON without their null fields."""
    return _t(spark, d, "orders").select("o_orderkey", more.without_nulls(F.struct(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("status"))).alias("row_json"))


# --- trees

_NAV = """WITH l AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS h,
 list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="([^"]*)">([^<]*)</a></li>', 2), lambda x: trim(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))) AS t FROM pages)"""


def _nav(spark, d):
    nodes = sources_pages.node_table(_t(spark, d, "pages"))
    return nodes, written(dom.within(dom.elements(nodes, "li"), dom.elements(nodes, "nav")))


@query(_NAV + """ SELECT DISTINCT page_id, x AS value FROM (SELECT page_id, unnest(h) AS x FROM l) WHERE regexp_matches(x, '^/[a-m]')""")
def dom_matching_attributes(spark, d):
    """Elements whose attribute matches a regular expression, and its values."""
    nodes = sources_pages.node_table(_t(spark, d, "pages"))
    found = dom.within(dom.elements(nodes, "a", like={"href": "^/[a-m]"}), dom.elements(nodes, "nav"))
    return dom.attribute(found, "href").select("page_id", "value")


@query(_NAV + """ SELECT page_id, count(*)::BIGINT AS items FROM (SELECT page_id, unnest(t) AS x FROM l) WHERE contains(lower(x), 'the') GROUP BY page_id""")
def dom_containing(spark, d):
    """List items whose text contains a word, in any case."""
    nodes, items = _nav(spark, d)
    return dom.containing(nodes, items, "The").groupBy("page_id").agg(F.count("*").alias("items"))


@query(_NAV + """ SELECT page_id, t[len(t) - 1] AS text, len(t)::BIGINT - 1 AS before FROM l WHERE len(t) > 1""")
def dom_before_last(spark, d):
    """The nearest sibling before the last item, by reverse numbering, and how many there are."""
    nodes, items = _nav(spark, d)
    before = written(dom.siblings(nodes, dom.at(items, [-1]), following=False))
    number = before.groupBy("page_id").agg(F.max("place").cast("long").alias("before"))
    return dom.all_text(nodes, before.filter("place = 1")).select("page_id", "text").join(number, "page_id")


@query(_NAV + """ SELECT page_id, x AS text FROM (SELECT page_id, unnest(t) AS x FROM l) WHERE x <> ''""")
def dom_text_nodes(spark, d):
    """Text nodes below the list items."""
    nodes, items = _nav(spark, d)
    return dom.text_nodes(nodes, items).select("page_id", "text")


@query("""SELECT page_id, sha256(regexp_extract(html, '(?s)<nav>.*?</nav>', 0)) AS outer_sha, sha256(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)) AS inner_sha FROM pages WHERE html LIKE '%<nav>%'""")
def dom_nav_html(spark, d):
    """V5: the navigation as HTML again, with and without its own tags."""
    nodes = sources_pages.node_table(_t(spark, d, "pages"))
    nav = dom.elements(nodes, "nav")
    outer, inner = dom.html(nodes, nav), dom.html(nodes, nav, inner=True)
    return outer.select("page_id", F.sha2("html", 256).alias("outer_sha")).join(inner.select("page_id", F.sha2("html", 256).alias("inner_sha")), "page_id")


@query("""SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\f\\x0b\\x{85}\\x{a0}\\x{3000}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) || chr(10) || '/i.png' ELSE text END) AS sha FROM documents""")
def content_texts(spark, d):
    """content as HTML, one paragraph a line and an image, or as plain text with entities, read as text."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))
    html = F.concat(F.lit("<p>"), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit("</p><img data-src='/i.png'>"))
    rows = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, html).otherwise(escaped).alias("content"))
    return dom.content_text(rows, "doc_id", "content").select("doc_id", F.sha2("text", 256).alias("sha"))


# --- values


@query("""SELECT page_id, CASE WHEN len(l) = 1 THEN 'value' ELSE 'list' END AS kind, len(l)::INT AS n, CASE WHEN regexp_matches(html, '<h1>[^<]+</h1>') THEN '<' || regexp_extract(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '[A-Za-z]+') || '>' END AS once
FROM (SELECT page_id, html, regexp_extract_all(html, '<p>([A-Za-z]+)', 1) AS l FROM pages)""")
def shaped_values(spark, d):
    """A value for one text, else a list; the value as a list; only the first match with its replacement, nothing without one."""
    p = _t(spark, d, "pages").select("page_id", tagged.shaped(F.regexp_extract_all("html", F.lit("<p>([A-Za-z]+)"), F.lit(1)), F.lit(True)).alias("v"), tagged.value(F.nullif(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit(""))).alias("h"))
    once = tagged.text_of(tagged.replaced(F.col("h"), "([A-Za-z]+)", "<$1>", once=True))
    return p.select("page_id", F.col("v")["kind"].alias("kind"), F.size(tagged.as_list(F.col("v"))["items"]).alias("n"), F.when(once == "", "<>").otherwise(once).alias("once"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/x?y' AS joined, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) END AS canonical FROM pages""")
def addresses(spark, d):
    """addresses in full, and as they are compared."""
    url = F.col("url")
    origin = F.regexp_extract(url, "^([a-z]+://[^/?#]*)", 1)
    odd = F.concat(F.upper(origin), F.expr("substring(url, length(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) + 1)"), F.lit(' , {"method":"POST"}'))
    return _t(spark, d, "pages").select("page_id", fv.absolute_url(F.lit("/x?y"), url).alias("joined"), fv.canonical_url(odd).alias("canonical"))


_PADS = [bytes(b ^ p for b in b"key".ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]


@query(f"""SELECT c_custkey, to_base64(unhex(sha256(c_name))) AS digest, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(c_name)))) AS hmac,
 c_name AS back, url_encode(c_name || ' é') AS encoded, url_encode(c_name) AS short, left(md5('["e",' || c_custkey || ']'), 16) AS cache, c_name AS deciphered FROM customer""")
def digests(spark, d):
    """digests, HMAC, hex, percent-encoding, file keys, ciphers."""
    c, key = F.col("c_name"), F.lit("0123456789abcdef")
    sent = F.base64(F.aes_encrypt(c, key, F.lit("CBC"), F.lit("PKCS")))
    cache = F.left(F.md5(F.concat(F.lit('["e",'), F.col("c_custkey").cast("string"), F.lit("]"))), F.lit(16))
    return _t(spark, d, "customer").select("c_custkey", fv.digest_base64(c, "sha256").alias("digest"), fv.hmac_hex(c, "key").alias("hmac"), fv.from_hex(F.hex(F.encode(c, "UTF-8"))).alias("back"), fv.uri_component(F.concat(c, F.lit(" é"))).alias("encoded"), fv.safe_key(c).alias("short"), cache.alias("cache"), more.aes_text(sent, key).alias("deciphered"))


@query("""SELECT conv_id, turn, regexp_replace(text, '[0-9]+|é', '#', 'g') AS replaced, sha256(text) AS unescaped_sha, contains(text, '<br>') OR turn % 2 = 0 AS html, '　　' || role || chr(10) || '　　' || turn AS intro FROM conversations""")
def more_texts(spark, d):
    """Guarded patterns, entities, whether a text looks like HTML, introductions."""
    x = F.col("text")
    escaped = F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("é"), F.lit("&eacute;"))
    intro = F.concat(F.lit("  <div class='x'>"), "role", F.lit("</div>&nbsp;<!-- c --><p><b >"), F.col("turn").cast("string"), F.lit("</b >　\n"))
    html = F.when(F.col("turn") % 2 == 0, F.concat(x, F.lit("<p>"))).otherwise(x)
    return _t(spark, d, "conversations").select("conv_id", "turn", more.guarded_replace(x, "[0-9]+|é", "#").alias("replaced"), F.sha2(more.unescaped(escaped), 256).alias("unescaped_sha"), fx.looks_like_html(html).alias("html"), fx.intro(intro).alias("intro"))


@query("""SELECT c_custkey, c_mktsegment || ',x' AS authors, c_mktsegment || ',' || c_name AS kinds, c_name AS plain, '★☆' AS icon, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_mktsegment ELSE '' END AS keyword,
 CASE c_custkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'audio' WHEN 2 THEN 'image' WHEN 3 THEN 'file' ELSE 'unknown' END AS type, 'q=%D6%D0&n=' || c_custkey AS form, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, c_mktsegment) AS rule FROM customer""")
def labels_and_rules(spark, d):
    """Labels of sources, forms in a character set, paired rules."""
    k, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    starred = F.concat(F.lit("★☆ "), name)
    return _t(spark, d, "customer").select(
        "c_custkey", fx.short_author(F.concat(segment, F.lit("， x、y"))).alias("authors"), fx.kind_label(F.array(segment, name)).alias("kinds"), more.without_icons(starred).alias("plain"), more.icon(starred).alias("icon"),
        more.sheet_keyword(name, F.when(k % 2 == 0, segment).otherwise(" ")).alias("keyword"), fv.source_kind((k % 5).cast("int")).alias("type"),
        fv.form_in_charset(F.concat(F.lit("q=%E4%B8%AD&n="), k.cast("string")), "gbk").alias("form"), federated.paired(F.when(k % 3 == 0, name).otherwise("  "), segment).alias("rule"),
    )


# --- rows


@query(f"""WITH {SOURCES} SELECT source_id, type = 'text' AND enabled AND len(groups) > 0 AND source_id % 3 <> 1 AS explore, regexp_matches(base_url, '^(?:http://s[0-9]+/?)$') AND source_id % 2 = 0 AS detail FROM sources WHERE source_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 100, 110, 120)""")
def chosen_sources(spark, d):
    """Sources by their ids, whether they take part in exploring, and whether an address is a detail's."""
    k = F.col("source_id")
    s = rule_sources(spark, d).withColumn("kinds", F.col("groups")).withColumn("explore", F.when(k % 3 == 1, False).when(k % 3 == 2, True))
    s = registry.chosen(s, [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 100, 110, 120], none_means_all=True)
    return s.select("source_id", registry.explore_participates().alias("explore"), more.is_detail(F.col("base_url"), F.when(k % 2 == 0, "http://s[0-9]+/?").otherwise(" ")).alias("detail"))


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END END AS name FROM customer""")
def backfilled(spark, d):
    """Missing fields filled from what was found, others kept."""
    c = _t(spark, d, "customer").withColumnRenamed("c_custkey", "key")
    old = c.select("key", F.when(F.col("key") % 2 == 0, F.col("c_name")).alias("name"))
    return registry.backfill(old, c.filter("key % 3 <> 0").select("key", F.col("c_mktsegment").alias("name")), "key", "name")


@query("""SELECT l_orderkey, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey % 4 END AS node, min(l_linenumber)::BIGINT AS start FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY ALL""")
def first_starts(spark, d):
    """Where each node's first unit begins."""
    rows = _t(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey") % 4).alias("node"), F.col("l_linenumber").cast("long").alias("start"))
    return sequences.first_start(rows, ["l_orderkey"], "node")


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY length(event_type) DESC, event_id)::INT AS place FROM events""")
def sent_cookies(spark, d):
    """The order in which a jar's cookies are sent."""
    return sequences.sent_order(_t(spark, d, "events"), "user_id", "event_type", "event_id").select("user_id", "event_id", "place")


@query("""WITH live AS (SELECT * FROM conversations WHERE (conv_id + turn) % 3 <> 0) SELECT conv_id AS book, turn AS id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM live""")
def pruned_entries(spark, d):
    """Entries whose target is gone leave, and their children rise."""
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("id"))
    path = F.when(F.col("id") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("id").cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    entries = c.select("book", F.col("id").cast("bigint").alias("id"), path.alias("path"))
    out = federated.pruned_tree(entries, entries.filter("(book + id) % 3 <> 0").select("book", "id"))
    return out.select("book", F.col("id").cast(c.schema["id"].dataType).alias("id"), F.col("parent").cast(c.schema["id"].dataType).alias("parent"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR epoch_ms(TIMESTAMP '1998-01-01') - epoch_ms(o_orderdate::TIMESTAMP) < 31536000000""")
def retained_results(spark, d):
    """ST7: results not finished, or finished within a year before a time."""
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("timestamp")).alias("finished"))
    return limits.visible(o, "finished", F.lit("1998-01-01").cast("timestamp"), 31_536_000_000).select("o_orderkey")


# --- functions that rows give their rules to, and selections of the tree beside those in catalog


@query("""WITH k AS (SELECT c_custkey AS k, c_name FROM customer), f AS (
  SELECT k, CASE k % 8 WHEN 0 THEN 'json' WHEN 1 THEN 'text' WHEN 2 THEN 'empty' WHEN 3 THEN 'js' WHEN 6 THEN 'json' ELSE 'unknown' END AS form,
    CASE k % 8 WHEN 0 THEN [c_name, 'two'] WHEN 1 THEN ['a', c_name] ELSE [] END AS titles FROM k)
SELECT k AS c_custkey, form, array_to_string(titles, '|') AS titles FROM f""")
def kind_forms(spark, d):
    """kinds declared as JSON or text, none, scripts, and what isn't readable."""
    k, name = F.col("c_custkey") % 8, F.col("c_name")
    as_json = F.concat(F.lit('[{"title":" '), name, F.lit('","url":"/1"},{"title":"no address"},{"title":"two","url":"/2 ","style":{}},{"title":3,"url":"/3"}]'))
    text = (
        F.when(k == 0, as_json).when(k == 1, F.concat(F.lit(" a::/1&&\n&&no\n::/2&&"), name, F.lit(" :: /3::more")))
        .when(k == 2, F.lit(" \n")).when(k == 3, F.lit("@js:1")).when(k == 4, F.lit('[{"title":"x"}]')).when(k == 5, F.lit('{"title":"x","url":"/"}'))
        .when(k == 6, F.lit("[]")).otherwise(F.lit("::&&::"))
    )
    read = federated.kinds_of(text)
    return _t(spark, d, "customer").select("c_custkey", read["form"].alias("form"), F.array_join(F.transform(read["kinds"], lambda x: x["title"]), "|").alias("titles"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN replace(o_clerk_, '#', '<' || o_orderstatus || '{{gone}}>') ELSE replace(o_clerk_, '0', o_orderpriority_) END AS clerk
FROM (SELECT o_orderkey, o_orderstatus, 'Clerk#' || o_orderkey || '0' AS o_clerk_, 'p' || o_custkey % 5 AS o_orderpriority_ FROM orders)""")
def row_tails(spark, d):
    """Replacements by each row's own pattern and template, with names filled from the row."""
    even = F.col("o_orderkey") % 2 == 0
    names = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.concat(F.lit("p"), (F.col("o_custkey") % 5).cast("string")))
    clerk = tagged.value(F.concat(F.lit("Clerk#"), F.col("o_orderkey").cast("string"), F.lit("0")))
    out = tagged.replaced_by_row(clerk, F.when(even, "#").otherwise("0"), F.when(even, "<{{ status }}{{gone}}>").otherwise("{{priority}}"), names)
    return _t(spark, d, "orders").select("o_orderkey", out["text"].alias("clerk"))


@query("""SELECT p_partkey, '卷一第' || p_partkey % 100 || '章 ' || p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE p_partkey % 100 END AS number FROM part""")
def chapter_numbers(spark, d):
    """F32: numbers in full-width digits and in numerals, in titles and alone."""
    digits = ["零", "一", "二", "三", "四", "五", "六", "七", "八", "九"]
    n = F.col("p_partkey") % 100
    one = lambda x: F.get(F.array(*map(F.lit, digits)), x.cast("int"))
    tens = F.floor(n / 10)
    written_ = F.when(n < 10, one(n)).otherwise(F.concat(F.when(tens > 1, one(tens)).otherwise(""), F.lit("十"), F.when(n % 10 > 0, one(n % 10)).otherwise("")))
    wide = F.translate(n.cast("string"), "0123456789", "０１２３４５６７８９")
    said = F.when(F.col("p_partkey") % 2 == 0, written_).otherwise(wide)
    alone = F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(said)
    return _t(spark, d, "part").select("p_partkey", fv.numbered_title(F.concat(F.lit("卷一第"), said, F.lit("章 "), F.col("p_name"))).alias("title"), fv.whole_number(alone).alias("number"))


@query("""SELECT c_custkey, 'b' AS accept, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'low' END AS agent, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END AS n FROM customer""")
def merged_headers(spark, d):
    """a request's headers over a source's, by name in any case; null values aren't stored."""
    even = F.col("c_custkey") % 2 == 0
    low = F.create_map(F.lit("User-Agent"), F.lit("low"), F.lit("accept"), F.lit("a"))
    high = F.create_map(F.lit("Accept"), F.lit("b"), F.lit("USER-AGENT"), F.when(even, F.col("c_name")), F.lit("X"), F.when(even, F.lit("x")))
    both = more.merged_headers(low, high)
    return _t(spark, d, "customer").select("c_custkey", both["accept"].alias("accept"), both["user-agent"].alias("agent"), F.size(both).alias("n"))


@query("""SELECT o_orderkey AS card FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderstatus = 'P'""")
def shown_cards(spark, d):
    """Cards that weren't muted since they last changed."""
    o = _t(spark, d, "orders")
    signature = F.concat_ws("/", "o_orderstatus", F.col("o_custkey").cast("string"))
    muted = o.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("card"), F.when(F.col("o_orderstatus") == "P", "before").otherwise(signature).alias("signature"))
    return registry.hidden_cards(o.select(F.col("o_orderkey").alias("card"), signature.alias("signature")), muted).select("card")


@query("""WITH h AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS hrefs FROM pages)
SELECT 'li' AS of, page_id, u.ord - 1 AS ord, u.href AS value FROM h, unnest(list_distinct_in_order(hrefs)) WITH ORDINALITY AS u(href, ord)
UNION ALL SELECT 'nav', page_id, 0, hrefs[1] FROM h WHERE len(hrefs) > 0""".replace("list_distinct_in_order(hrefs)", "list_filter(hrefs, lambda x, i: list_position(hrefs, x) = i)"))
def dom_nearest_links(spark, d):
    """V6: an address of each element: its own, or that of the first element below; of items, and of whole navigations."""
    nodes = sources_pages.node_table(_t(spark, d, "pages"))
    nav = dom.elements(nodes, "nav")
    items = dom.attribute_or_below(nodes, dom.within(dom.elements(nodes, "li"), nav), "href").select(F.lit("li").alias("of"), "page_id", "ord", "value")
    return items.union(dom.attribute_or_below(nodes, nav, "href").select(F.lit("nav"), "page_id", "ord", "value"))


@query("""SELECT page_id, 'nav' AS parent, 'ul' AS child, 1 AS n FROM pages UNION ALL SELECT page_id, 'ul', 'li', len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>')) FROM pages WHERE regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) LIKE '%<li>%'
UNION ALL SELECT page_id, 'up', 'ul', 1 FROM pages WHERE regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) LIKE '%<li>%'""")
def dom_children(spark, d):
    """Children of elements, and the parents of those again."""
    nodes = sources_pages.node_table(_t(spark, d, "pages"))
    nav = dom.elements(nodes, "nav")
    lists = dom.children(nodes, nav, "ul")
    items = dom.children(nodes, lists)
    counted = lambda rows, parent: rows.groupBy("page_id", F.col("tag").alias("child")).agg(F.count("*").cast("int").alias("n")).select("page_id", F.lit(parent).alias("parent"), "child", "n")
    return counted(lists, "nav").union(counted(items, "ul")).union(counted(dom.parents(nodes, items), "up"))
