"""Units of a text that are read aloud one after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE, is_spoken

#: Characters of a unit, ends of sentences.
MOST, SENTENCE_END = 300, "。！？；…"


def _packed(line: Column, most: int) -> Column:
    """A line in units of at most `most` characters: whole sentences while they fit, longer ones cut."""
    pieces = F.split(line, f"(?<=[{SENTENCE_END}])")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, piece: Column) -> Column:
        fits = F.length(state["open"]) + F.length(piece) <= most
        chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.length(piece), F.lit(1)), F.lit(most)), lambda i: F.substring(piece, i, F.lit(most)))
        done = F.concat(state["done"], F.when(state["open"] != "", F.array(state["open"])).otherwise(F.array().cast("array<string>")), F.slice(chunks, F.lit(1), F.size(chunks) - 1))
        return F.when(fits, F.struct(state["done"].alias("done"), F.concat(state["open"], piece).alias("open"))).otherwise(F.struct(done.alias("done"), F.element_at(chunks, -1).alias("open")))

    end = lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
    return F.when(F.length(line) <= most, F.array(line)).otherwise(F.aggregate(pieces, start, step, end))


def units_of(text: Column, most: int = MOST) -> Column:
    """The units of a text: by line, trimmed, without lines of punctuation alone."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)))
    return F.flatten(F.transform(F.filter(lines, lambda x: (x != "") & is_spoken(x)), lambda x: _packed(x, most)))


def units(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """key, ord, unit: the units in order."""
    return docs.select(key, F.posexplode(units_of(F.col(text), most)).alias("ord", "unit"))
