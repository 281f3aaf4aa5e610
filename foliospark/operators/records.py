"""Records of several fields from regions of pages, with a rule for each field's errors; one pass over the elements.

A region is an element that region steps find; the fields' steps begin at it, not at the page. Regions may lie in each other: an element
then counts for each of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chains import Step, found, found_at


@dataclass(frozen=True)
class Field:
    """A value of a region: an attribute, or the text directly in the first element found that has one (no steps: the region's own).

    Blank values are none. With a pattern the value is its first group; a value that doesn't match is an error. Then
    fails says what happens: "page" is an error of the whole page, "null" leaves the field empty. needed: a region without the
    value is no record, whatever its other fields are.
    """

    name: str
    steps: tuple[Step, ...] = ()
    attr: str | None = None
    pattern: str | None = None
    fails: str = "null"
    needed: bool = False


def _value(field: Field, rest: Column) -> Column:
    here = F.size(rest) == 0 if not field.steps else found(rest, list(field.steps))
    raw = F.col("attrs")[field.attr] if field.attr else F.regexp_replace("own_text", r"\s+", " ")
    return F.when(here, F.nullif(F.btrim(raw), F.lit("")))


def records(chains: DataFrame, region: list[Step], fields: list[Field]) -> tuple[DataFrame, DataFrame]:
    """Records (page_id, region, a column for each field) and errors (page_id, field) of pages (element_chains).

    Of a page the first error (by region, then by the order of the fields) is reported, and it has no records then. Errors of
    fields that a record doesn't get to (as a needed one is missing) don't count, nor do those of fields that may be empty.
    """
    chain = F.col("chain")
    rows = chains.select("page_id", "node_id", "attrs", "own_text", "chain", F.explode(found_at(chain, region)).alias("__d"))
    rest = F.slice(chain, F.col("__d") + 1, F.size(chain))
    rows = rows.select("page_id", "node_id", F.element_at(chain, F.col("__d"))["node"].alias("region"), *[_value(f, rest).alias(f.name) for f in fields])
    whole = rows.groupBy("page_id", "region").agg(*[F.min_by(F.col(f.name), F.when(F.col(f.name).isNotNull(), F.col("node_id"))).alias(f.name) for f in fields])
    judged = whole
    for f in fields:
        if f.pattern is not None:
            judged = judged.withColumn(f"__bad_{f.name}", F.coalesce(~F.col(f.name).rlike(f.pattern), F.lit(False)))
            judged = judged.withColumn(f.name, F.when(~F.col(f"__bad_{f.name}"), F.regexp_extract(F.col(f.name), f.pattern, 1)))
    lacking, error = F.lit(False), F.lit(None).cast("string")
    for f in fields:  # in order: an error of a field counts if nothing needed was missing before
        if f.pattern is not None and f.fails == "page":
            error = F.coalesce(error, F.when(~lacking & F.col(f"__bad_{f.name}"), F.lit(f.name)))
        if f.needed:
            lacking = lacking | F.col(f.name).isNull()
    judged = judged.withColumns({"__lacking": lacking, "__error": error})
    failed = judged.filter("__error IS NOT NULL").groupBy("page_id").agg(F.min_by("__error", "region").alias("field"))
    kept = judged.filter("NOT __lacking AND __error IS NULL").join(failed.select("page_id"), "page_id", "left_anti")
    return kept.select("page_id", "region", *[f.name for f in fields]), failed


def details(chains: DataFrame, region: list[Step], fields: list[Field]) -> tuple[DataFrame, DataFrame]:
    """As records, of the first region of each page; a page without it (or whose region lacks a needed field) is an error, of field NO_REGION."""
    kept, failed = records(chains, region, fields)
    first = kept.groupBy("page_id").agg(F.min_by(F.struct("region", *[f.name for f in fields]), "region").alias("r")).select("page_id", "r.*")
    none = chains.select("page_id").distinct().join(first, "page_id", "left_anti").join(failed, "page_id", "left_anti")
    return first, failed.union(none.select("page_id", F.lit("NO_REGION")))
