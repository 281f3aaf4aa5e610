"""Rows from pages and JSON with column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..shared import written


def regex_rows(df: DataFrame, text: str, pattern: str, groups: int) -> DataFrame:
    """One row for each match of a pattern in the whole text: ord and g0 (all of it) to gN; a group without a match is empty."""
    arrays = F.arrays_zip(*[F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(groups + 1)])
    rows = df.select("*", F.posexplode(arrays).alias("ord", "__m"))
    return rows.select(*df.columns, F.col("ord").cast("long").alias("ord"), *[F.coalesce(F.col(f"__m.g{g}"), F.lit("")).alias(f"g{g}") for g in range(groups + 1)])


def bound(template: str, groups: int) -> Column:
    """A field's template with $n bound to the row's groups; a group that isn't there is empty."""
    parts, at = [], 0
    import re

    for m in re.finditer(r"\$(\d{1,2})", template):
        parts += [F.lit(template[at : m.start()]), F.col(f"g{int(m[1])}") if int(m[1]) <= groups else F.lit("")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def literal(template: str, values: dict[str, Column]) -> Column:
    """A text with {{name}} filled in; a null value makes the whole null, an unknown name stays as it is."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*\}\}", template):
        parts += [F.lit(template[at : m.start()]), values.get(m[1], F.lit(m[0]))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def json_path(x: Column, path: str) -> Column:
    """What a path of names, indexes from the front and [*] gives; other forms are errors at once (json_steps and json_below have them; filters and scripts no one)."""
    import re

    path = path.strip()
    path = path if path.startswith("$") else "$" + (path if path[:1] in (".", "[") else f".{path}")
    if not re.fullmatch(r"\$(?:\.[\w-]+|\[\d+\]|\[\*\])*", path):
        raise ValueError(f"not supported here: {path}")
    return F.get_json_object(x, path)


def json_steps(x: Column, *steps: str | int | slice) -> Column:
    """JSON texts of what steps lead to, as an array: a name, an index (negative from the end), a slice (of step 1), or "*" for all
    items or values. What a step doesn't find is left out; a text that isn't JSON has nothing."""
    found = F.array(F.try_parse_json(x))
    for step in steps:
        array = lambda v: F.try_variant_get(v, "$", "array<variant>")
        if step == "*":
            values = lambda v: F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
            found = F.flatten(F.transform(found, lambda v: F.coalesce(array(v), values(v), F.array().cast("array<variant>"))))
        elif isinstance(step, slice):
            found = F.flatten(F.transform(found, lambda v: F.coalesce(let(array(v), lambda a: _sliced(a, step)), F.array().cast("array<variant>"))))
        elif isinstance(step, int):
            found = F.transform(found, lambda v: F.try_element_at(array(v), F.lit(step + 1 if step >= 0 else step)))
        else:
            found = F.transform(found, lambda v: F.try_variant_get(v, f"$['{step}']", "variant"))
        found = F.filter(found, lambda v: v.isNotNull())
    return F.transform(found, lambda v: F.to_json(v))


def _sliced(a: Column, s: slice) -> Column:
    n = F.size(a)
    end = lambda k, default: F.lit(default) if k is None else F.lit(k) if k >= 0 else n + k
    first = F.greatest(end(s.start, 0), F.lit(0))
    last = F.least(n if s.stop is None else end(s.stop, 0), n)
    return F.filter(a, lambda x, i: (i >= first) & (i < last))


def json_below(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """key, at (array of places from the top), value (JSON text) of everything of a name in JSON texts, at any depth; a level at a time, until none is left."""
    tvf = rows.sparkSession.tvf
    level = written(rows.select(key, F.array().cast("array<int>").alias("at"), F.try_parse_json(text).alias("v")).filter("v IS NOT NULL"))
    found = None
    while True:
        kids = level.lateralJoin(tvf.variant_explode(F.col("v").outer())).select(key, F.array_append("at", F.col("pos")).alias("at"), F.col("key").alias("__name"), F.col("value").alias("v"))
        kids = written(kids)
        own = kids.filter(F.col("__name") == name).select(key, "at", F.to_json("v").alias("value"))
        found = own if found is None else found.union(own)
        if kids.isEmpty():
            return found
        level = kids.select(key, "at", "v")


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, ord, href of the links in a page's navigation, each address of a page once."""
    nav = F.regexp_extract(html, r"(?s)<nav>(.*?)</nav>", 1)
    hrefs = F.array_distinct(F.regexp_extract_all(nav, F.lit('<a href="([^"]*)"'), F.lit(1)))
    return pages.select("page_id", F.posexplode(F.filter(hrefs, lambda h: h != "")).alias("ord", "href"))
