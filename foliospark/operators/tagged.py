"""Rule values as columns: miss, value, list and matches are told apart, and combined.

A value is a struct: kind, text (of a value), items (of a list), rows (of matches).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.binding import let

TYPE = "struct<kind:string,text:string,items:array<string>,rows:array<array<string>>>"


def _make(kind: str, text: Column | None = None, items: Column | None = None, rows: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), (null if text is None else text).cast("string").alias("text"), (null if items is None else items).cast("array<string>").alias("items"), (null if rows is None else rows).cast("array<array<string>>").alias("rows"))


def miss() -> Column:
    return _make("miss")


def value(text: Column) -> Column:
    """A value; a null text is a miss."""
    return F.when(text.isNotNull(), _make("value", text=text)).otherwise(miss())


def listed(items: Column) -> Column:
    """A list, which may be empty; a null array is a miss."""
    return F.when(items.isNotNull(), _make("list", items=items)).otherwise(miss())


def matches(rows: Column) -> Column:
    """Rows of a regular expression's groups; none is the empty list."""
    return F.when(F.size(rows) > 0, _make("matches", rows=rows)).otherwise(_make("list", items=F.array().cast("array<string>")))


def shaped(items: Column, single: Column) -> Column:
    """A value if one node gave one text, else a list."""
    return F.when(single & (F.size(items) == 1), value(F.get(items, F.lit(0)))).otherwise(listed(items))


def _is_empty(v: Column) -> Column:
    return (v["kind"] == "miss") | ((v["kind"] == "list") & (F.size(v["items"]) == 0))


def _items(v: Column) -> Column:
    return F.when(v["kind"] == "value", F.array(v["text"])).when(v["kind"] == "list", v["items"]).otherwise(F.array().cast("array<string>"))


def _none() -> Column:
    return F.array().cast("array<string>")


def as_list(v: Column) -> Column:
    """A value as a list of one, for a rule that is asked for a list; others as they are."""
    return let(v, lambda x: F.when(x["kind"] == "value", listed(F.array(x["text"]))).otherwise(x))


def first(*values: Column) -> Column:
    """The first that is neither a miss nor an empty list; all misses: a miss, else the empty list."""

    def use(all_: Column) -> Column:
        nothing = F.when(F.exists(all_, lambda v: v["kind"] != "miss"), listed(_none())).otherwise(miss())
        return F.coalesce(F.get(F.filter(all_, lambda v: ~_is_empty(v)), F.lit(0)), nothing)

    return let(F.array(*values), use)


def both(*values: Column) -> Column:
    """All values joined by line ends, or with a list among them one list; what is empty doesn't count; matches stand alone only."""

    def use(full: Column) -> Column:
        items = F.flatten(F.transform(full, _items))
        merged = F.when(F.exists(full, lambda v: v["kind"] == "list"), listed(items)).otherwise(value(F.array_join(items, "\n")))
        alone = F.when(F.size(full) == 1, F.get(full, F.lit(0))).otherwise(F.raise_error(F.lit("matches can't be merged with other branches")).cast(TYPE))
        return F.when(F.size(full) == 0, miss()).when(F.exists(full, lambda v: v["kind"] == "matches"), alone).otherwise(merged)

    return let(F.filter(F.array(*values), lambda v: ~_is_empty(v)), use)


def interleaved(*values: Column, as_list: bool = False) -> Column:
    """Items taken in turn, as many rounds as the first branch has; as_list counts empty branches as such."""
    branches = F.transform(F.array(*values), _items)
    if not as_list:
        branches = F.filter(branches, lambda b: F.size(b) > 0)

    def use(b: Column) -> Column:
        rounds = F.coalesce(F.size(F.get(b, F.lit(0))), F.lit(0))
        turns = F.transform(F.sequence(F.lit(0), F.greatest(rounds, F.lit(1)) - 1), lambda i: F.filter(F.transform(b, lambda x: F.get(x, i)), lambda x: x.isNotNull()))
        return F.when(rounds > 0, F.flatten(turns)).otherwise(_none())

    return let(let(branches, use), lambda items: F.when(F.size(items) > 0, listed(items)).otherwise(miss()))


def reversed_(v: Column) -> Column:
    """Items or rows in reverse; other values as they are."""
    return let(v, lambda x: F.when(x["kind"] == "list", listed(F.reverse(x["items"]))).when(x["kind"] == "matches", matches(F.reverse(x["rows"]))).otherwise(x))


def interpolated(text: Column, values: Column) -> Column:
    """A text with each {{name}} (blanks around it allowed) as the value of a map, in one pass; names that the map hasn't, or has as null, stay as they are."""
    token = r"\{\{\s*([\w.]+)\s*\}\}"
    names, whole = F.regexp_extract_all(text, F.lit(token), F.lit(1)), F.regexp_extract_all(text, F.lit(token), F.lit(0))
    filled = F.concat(F.transform(F.arrays_zip(names.alias("n"), whole.alias("w")), lambda t: F.coalesce(F.try_element_at(values, t["n"]), t["w"])), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(text, token, -1), filled, lambda a, b: F.concat(a, b)), "")


def replaced_by_row(v: Column, pattern: Column, replacement: Column, values: Column) -> Column:
    """Replaces in a value or each item by a row's own pattern and replacement, whose {{name}} are filled from the row's map first."""
    on = lambda x: F.regexp_replace(x, pattern, let(interpolated(replacement, values), lambda r: r))
    return let(v, lambda x: F.when(x["kind"] == "value", value(on(x["text"]))).when(x["kind"] == "list", listed(F.transform(x["items"], on))).otherwise(x))


def replaced(v: Column, pattern: str, replacement: str = "", once: bool = False) -> Column:
    """Replaces in a value or each item. once: only the first match is left, with its replacement; none leaves an empty text. An empty pattern changes nothing."""
    if not pattern:
        return v

    def on(x: Column) -> Column:
        return F.regexp_replace(F.regexp_extract(x, pattern, 0), pattern, replacement) if once else F.regexp_replace(x, pattern, replacement)

    return let(v, lambda x: F.when(x["kind"] == "value", value(on(x["text"]))).when(x["kind"] == "list", listed(F.transform(x["items"], on))).otherwise(x))


def text_of(v: Column) -> Column:
    """A field's text: list items joined by line ends, the first group of matches; null for a miss."""

    def use(x: Column) -> Column:
        groups = F.transform(x["rows"], lambda r: F.get(r, F.when(F.size(r) > 1, 1).otherwise(0)))
        return F.when(x["kind"] == "value", x["text"]).when(x["kind"] == "list", F.array_join(x["items"], "\n")).when(x["kind"] == "matches", F.array_join(groups, "\n"))

    return let(v, use)


def url_of(v: Column) -> Column:
    """An address field's text: the first item."""
    return let(v, lambda x: F.when(x["kind"] == "value", x["text"]).when(x["kind"] == "list", F.get(x["items"], F.lit(0))))


def positions(spec: list, n: Column) -> Column:
    """0-based places that an index names among n: whole numbers (negative from the end), and (from, to, step) closed ranges, cut to what is there; each place once, in order of naming."""
    parts = []
    for s in spec:
        if isinstance(s, tuple):
            low, high, step = (*s, None)[:3]
            at = lambda x: F.least(F.greatest(F.lit(x) + F.when(F.lit(x) < 0, n).otherwise(0), F.lit(0)), n - 1)
            a, b = at(low), at(high)
            by = F.when(a <= b, abs(step or 1)).otherwise(-abs(step or 1))
            parts.append(F.when(n > 0, F.sequence(a, b, by)).otherwise(F.array().cast("array<int>")))
        else:
            at = F.lit(s) + F.when(F.lit(s) < 0, n).otherwise(0)
            parts.append(F.when((at >= 0) & (at < n), F.array(at.cast("int"))).otherwise(F.array().cast("array<int>")))
    return F.array_distinct(F.flatten(F.array(*parts)))


def picked(items: Column, spec: list | None = None, exclude: list | None = None) -> Column:
    """Items without those at the excluded places, then those that the index names; nothing left is a miss."""
    out = items
    if exclude:
        gone = positions(exclude, F.size(items))
        out = F.filter(out, lambda x, i: ~F.array_contains(gone, i))
    if spec is not None:
        kept = out
        out = F.transform(positions(spec, F.size(kept)), lambda i: F.get(kept, i))
    return F.when(F.size(out) > 0, listed(out)).otherwise(miss())
