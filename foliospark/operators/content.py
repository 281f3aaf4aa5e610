"""Structured contents (nested JSON of nodes) as lines: the tree is flattened level by level, its places put the parts in order.

A content is a JSON array of nodes {"kind": ...}: text (text), image (alt), break, rule, element (tag, id, children) and
link (children). The place of a node is the array of its positions from the top, by which arrays sort as the document does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written

#: Elements that begin and end lines, cells, and what stands for an image.
BLOCKS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "li", "table", "caption", "thead", "tbody", "tfoot", "tr")
CELLS = ("td", "th")
IMAGE, IMAGE_OF = "[图片]", "[图片：%s]"
#: White space, of which Java's \s is only the ASCII part.
_BLANKS = "[\\s   -     　﻿]+"
#: Places after all others of a parent: a row's text outside its cells, and the end of a block.
_STRAY, _END = 2**30, 2**31 - 1


def _folded(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, _BLANKS, " "))


def _within(at: Column, depth: Column) -> Column:
    return F.slice(at, F.lit(1), depth)


def parts(rows: DataFrame, key: str, content: str) -> DataFrame:
    """__key, at, part and what belongs to it: texts (text, pre, live, owner, owner_id), line ends (line, depth), cells' starts (cell, depth, owner_id).

    live: depths of the blocks around a text; owner: the depth of the innermost one, owner_id its id. Each level is
    written once with what is below it; it is the last one if nothing is.
    """
    tvf, ints = rows.sparkSession.tvf, F.array().cast("array<int>")
    level = rows.select(
        F.col(key).alias("__key"), ints.alias("at"), F.lit(False).alias("pre"), ints.alias("live"), F.lit(0).alias("owner"), F.lit(None).cast("string").alias("owner_id"), F.lit(False).alias("row"), F.lit(False).alias("stray"), F.try_parse_json(content).alias("v")
    ).filter("v IS NOT NULL")
    found = []
    while True:
        get = lambda name, kind: F.try_variant_get("value", f"$.{name}", kind)
        own = level.lateralJoin(tvf.variant_explode(F.col("v").outer())).filter("key IS NULL").withColumnRenamed("pos", "place")
        own = own.select(*[c for c in level.columns if c != "v"], "place", get("kind", "string").alias("kind"), F.lower(get("tag", "string")).alias("tag"), get("id", "string").alias("id"), get("text", "string").alias("text"), get("alt", "string").alias("alt"), get("children", "variant").alias("v"))
        element = F.col("kind") == "element"
        cell = F.col("row") & element & F.col("tag").isin(*CELLS)
        astray = F.col("row") & ~F.coalesce(cell, F.lit(False))
        own = own.withColumns({"cell": F.coalesce(cell, F.lit(False)), "astray": astray, "block": F.coalesce(element & F.col("tag").isin(*BLOCKS), F.lit(False)), "up": F.col("at")})
        own = own.withColumn("at", F.when(F.col("astray"), F.concat("at", F.array(F.lit(_STRAY), F.col("place")))).otherwise(F.array_append("at", F.col("place"))))
        depth = F.size("at")
        own = own.withColumns({"stray": F.col("stray") | F.col("astray"), "live": F.when(F.col("astray"), F.array_append("live", F.size("up") + 1)).otherwise(F.col("live"))})
        claims = F.col("block") & ~F.col("stray")
        own = own.withColumns({
            "live": F.when(F.col("block"), F.array_append("live", depth)).otherwise(F.col("live")),
            "owner": F.when(claims, depth).otherwise(F.col("owner")),
            "owner_id": F.when(claims, F.col("id")).otherwise(F.col("owner_id")),
            "pre": F.col("pre") | F.coalesce(claims & (F.col("tag") == "pre"), F.lit(False)),
        })
        seen = Observation()
        inner = F.col("kind").isin("element", "link") & F.col("v").isNotNull()
        own = written(own.withColumn("v", F.when(inner, F.col("v"))).observe(seen, F.count_if(inner).alias("inner")))
        found.append(own.drop("v"))
        if not seen.get["inner"]:
            break
        level = own.filter("v IS NOT NULL").select("__key", "at", "pre", "live", "owner", "owner_id", (element & (F.col("tag") == "tr")).alias("row"), "stray", "v")
    flat = reduce(DataFrame.union, found)
    none = F.lit(None)
    alt = F.btrim(F.regexp_replace(F.coalesce("alt", F.lit("")), f"^{_BLANKS}|{_BLANKS}$", ""))
    image = F.when(alt == "", F.lit(IMAGE)).otherwise(F.format_string(IMAGE_OF, alt))
    plain = F.coalesce("text", F.lit(""))
    text = F.when(F.col("kind") == "text", F.when(F.col("pre"), plain).otherwise(F.regexp_replace(plain, _BLANKS, " "))).when(F.col("kind") == "image", image).otherwise(F.lit("\n"))
    columns = lambda what, at, **own: [F.col("__key"), at.alias("at"), F.lit(what).alias("part"), *[own.get(c, none).cast(t).alias(c) for c, t in (("text", "string"), ("pre", "boolean"), ("live", "array<int>"), ("depth", "int"), ("owner", "int"), ("owner_id", "string"))]]
    texts = flat.filter("kind IN ('text', 'image', 'break')").select(*columns("text", F.col("at"), text=text, pre=F.col("pre"), live=F.col("live"), owner=F.col("owner"), owner_id=F.col("owner_id")))
    opened = flat.filter("block OR kind = 'rule'").select(*columns("line", F.col("at"), depth=F.size("at")))
    closed = flat.filter("block").select(*columns("line", F.array_append("at", F.lit(_END)), depth=F.size("at")))
    cells = flat.filter("cell").select(*columns("cell", F.col("at"), depth=F.size("up"), owner=F.col("owner"), owner_id=F.col("owner_id")))
    strays = flat.filter("astray").select("__key", F.array_append("up", F.lit(_STRAY)).alias("at"), "up", "owner", "owner_id").distinct()
    strays = strays.select(*columns("cell", F.col("at"), depth=F.size("up"), owner=F.col("owner"), owner_id=F.col("owner_id")))
    return texts.union(opened).union(closed).union(cells).union(strays)


def content_lines(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, line_no (from 0), text, node_id of contents (JSON arrays of nodes, or null).

    Blocks and rules begin and end lines, breaks end them; blanks in a line are one, and blank lines are left out. Text in a pre
    stays as it is, a pre without any is left out. Cells of a row are joined by tabs, the last line of one to the first of the next; a row's text
    outside its cells is its last cell; rows without text are left out. node_id is the id of the innermost block whose first
    line it is. Texts that aren't JSON arrays have no lines; repeated keys are one content.
    """
    all_parts = written(parts(rows, key, content))
    name, key = key, "__key"
    texts = all_parts.filter("part = 'text'")
    said = texts.filter(F.regexp_replace("text", _BLANKS, "") != "")
    alive = said.select(key, F.explode("live").alias("d"), "at").select(key, _within(F.col("at"), F.col("d")).alias("alive")).distinct()
    alive = written(alive)
    # a pre's blank lines stay if it says something; a row stays if it does
    kept = lambda df, at: df.join(alive.withColumnRenamed("alive", "__at"), [F.col(at) == F.col("__at"), df[key] == alive[key]], "left_semi")
    verbatim = kept(texts.filter("pre").withColumn("__block", _within(F.col("at"), F.element_at("live", -1))), "__block").drop("__block")
    cells = all_parts.filter("part = 'cell'")
    row_of = F.when(F.element_at("at", -1) == _STRAY, F.col("at")).otherwise(_within(F.col("at"), F.col("depth")))
    cells = kept(cells.withColumn("__row", row_of), "__row").drop("__row")
    first = Window.partitionBy(key, _within(F.col("at"), F.col("depth"))).orderBy("at")
    cells = cells.withColumn("__n", F.row_number().over(first)).filter("__n > 1").drop("__n")
    lines = all_parts.filter("part = 'line'")
    # texts that nothing separates are one run
    in_order = Window.partitionBy(key).orderBy("at")
    runs = texts.filter("NOT pre").union(verbatim).union(lines).union(cells).withColumn("run", F.sum(F.when(F.col("part") == "text", 0).otherwise(1)).over(in_order))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    runs = runs.filter("part = 'text'").groupBy(key, "run").agg(joined.alias("text"), F.min("at").alias("at"), F.first("pre").alias("pre"), F.first("owner").alias("owner"), F.first("owner_id").alias("owner_id"))
    split = F.split("text", "\n", -1)
    pieces = F.when(F.col("pre"), F.when(F.col("text") != "", split).otherwise(F.array().cast("array<string>"))).otherwise(F.filter(F.transform(split, _folded), lambda x: x != ""))
    names = [key, "at", "k", "text", "depth", "owner", "owner_id", "item"]
    items = runs.select(key, "at", F.posexplode(pieces).alias("k", "text"), F.lit(_END).alias("depth"), "owner", "owner_id", F.lit(1).alias("item")).select(*names)
    items = items.union(cells.select(key, "at", F.lit(0).alias("k"), F.lit("\t").alias("text"), "depth", "owner", "owner_id", F.lit(1).alias("item")).select(*names))
    ends = lines.select(key, "at", F.lit(0).alias("k"), F.lit(None).cast("string").alias("text"), "depth", F.lit(0).alias("owner"), F.lit(None).cast("string").alias("owner_id"), F.lit(0).alias("item")).select(*names)
    # the outermost line end since the item before; within a cell, line ends at its edges don't count
    order = Window.partitionBy(key).orderBy("at", "k")
    gaps = items.union(ends).withColumn("gap", F.coalesce(F.sum("item").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    outermost = F.min(F.when(F.col("item") == 0, F.col("depth"))).over(Window.partitionBy(key, "gap"))
    placed = gaps.withColumn("outermost", outermost).filter("item = 1")
    before = lambda c: F.lag(c).over(order)
    new = before("at").isNotNull() & ((F.col("k") > 0) | F.coalesce(F.col("outermost") <= F.least(F.col("depth"), before("depth")), F.lit(False)))
    heads = F.coalesce(_within(before("at"), F.col("owner")) != _within(F.col("at"), F.col("owner")), F.lit(True)) & (F.col("owner") > 0)
    placed = placed.withColumns({"head": F.when(heads, F.col("owner_id")), "new": F.when(new, 1).otherwise(0)})
    placed = placed.withColumn("line_no", F.sum("new").over(order))
    row = F.sort_array(F.collect_list(F.struct("at", "k", "text", "head")))
    out = placed.groupBy(key, "line_no").agg(row.alias("row"))
    return out.select(F.col(key).alias(name), F.col("line_no").cast("long").alias("line_no"), F.array_join(F.transform("row", lambda x: x["text"]), "").alias("text"), F.col("row")[0]["head"].alias("node_id"))
