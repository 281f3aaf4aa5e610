"""Source registry: participation, facets, statistics, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import dedup_key


def participates() -> Column:
    """Enabled text sources."""
    return F.col("enabled") & (F.col("type") == "text")


def ai_participates() -> Column:
    """Those whose flag is exactly true."""
    return participates() & F.coalesce(F.col("ai_search"), F.lit(False))


def explore_participates() -> Column:
    return participates() & (F.size("kinds") > 0) & F.coalesce(F.col("explore"), F.lit(True))


def chosen(sources: DataFrame, ids: list | None, none_means_all: bool) -> DataFrame:
    """Sources of the given ids. No ids at all: every source on the page, none for tools."""
    if not ids:
        return sources if none_means_all else sources.limit(0)
    return sources.filter(F.col("source_id").isin(ids))


def matches(text: str, status: str | None = None, group: str | None = None, ungrouped: bool = False) -> Column:
    """List filter: text within name, address or a group (any case); a status; a group, or none."""
    t = text.strip().lower()
    out = F.lit(True)
    if t:
        out = F.contains(F.lower("name"), F.lit(t)) | F.contains(F.lower("base_url"), F.lit(t)) | F.exists("groups", lambda g: F.contains(F.lower(g), F.lit(t)))
    if status is not None:
        out = out & (F.col("status") == status)
    if ungrouped:
        return out & (F.size("groups") == 0)
    return out if group is None else out & F.array_contains("groups", group)


def facet_counts(sources: DataFrame) -> DataFrame:
    """group, sources: over all sources; the null group counts those without any."""
    named = sources.select(F.explode_outer(F.array_distinct("groups")).alias("group"))
    return named.groupBy("group").agg(F.count("*").alias("sources"))


def statistics(sources: DataFrame) -> DataFrame:
    c = F.count_if
    return sources.agg(F.count("*").alias("total"), c(F.col("enabled")).alias("enabled"), c(~F.col("enabled")).alias("disabled"), c(ai_participates()).alias("ai"), c(F.col("status") == "unverified").alias("unverified"), c(F.col("status") == "broken").alias("broken"))


def job_counts(outcomes: DataFrame) -> DataFrame:
    """ok, failed, dup_skipped, replaced of an import's outcomes: one row."""
    c = lambda *k: F.count_if(F.col("outcome").isin(*k))
    return outcomes.agg(c("added", "replaced").alias("ok"), c("failed").alias("failed"), c("skipped-batch", "skipped-verified").alias("dup_skipped"), c("replaced").alias("replaced"))


def findings(log: DataFrame, examples: int = 3) -> DataFrame:
    """key, n, examples: how often each finding stands, and its first examples. A key's rows are cut to these before they are shuffled."""
    first = log.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy("ord"))).filter(F.col("__n") <= examples)
    shown = first.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "example"))), lambda e: e["example"]).alias("examples"))
    return log.groupBy("key").agg(F.count("*").alias("n")).join(shown, "key")


def intake(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Outcome of each row of an import (ord, name, base_url) against the known sources (source_id, base_url, status, ord).

    Addresses are compared without slashes at the end. Of a batch only the first of an address counts,
    later ones are skipped-batch. A verified known source is kept (skipped-verified); else the first known
    one is replaced and its others cleared; without a known one the row is added.
    """
    batch = batch.withColumn("key", dedup_key(F.col("base_url")))
    batch = batch.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy("ord")))
    verified = F.col("status") == "verified"
    held = known.withColumn("key", dedup_key(F.col("base_url"))).groupBy("key").agg(
        F.min_by("source_id", F.struct((~verified).alias("worse"), "ord")).alias("existing"), F.bool_or(verified).alias("__verified"), (F.count("*") - 1).alias("__rest")
    )
    out = batch.join(held, "key", "left")
    outcome = F.when(F.col("__n") > 1, "skipped-batch").when(F.col("existing").isNull(), "added").when(F.col("__verified"), "skipped-verified").otherwise("replaced")
    return out.select("ord", "name", "base_url", outcome.alias("outcome"), "existing", F.when(outcome == "replaced", F.col("__rest")).otherwise(0).cast("long").alias("cleared"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key (one each); a null of the new row keeps the old value."""
    fields = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    return joined.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in fields])


def backfill(old: DataFrame, found: DataFrame, key: str, field: str) -> DataFrame:
    """Fills a missing field, never overwrites one."""
    fill = found.select(key, F.col(field).alias("__fill"))
    return old.join(fill, key, "left").withColumn(field, F.coalesce(field, "__fill")).select(*old.columns)


def subtract(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone, key, "left_anti")


def among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return rows.join(wanted, key, "left_semi")


def lookup(rows: DataFrame, table: DataFrame, key: str, *fields: str) -> DataFrame:
    """Left join to a table with a row for each key; missing ones are null. AQE broadcasts the table if it measures small."""
    return rows.join(table.select(key, *fields), key, "left")


def signature(ids: DataFrame, group: str, key: str) -> DataFrame:
    """A group's sorted keys as one text."""
    return ids.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), "|").alias("signature"))


def validated(sources: DataFrame) -> DataFrame:
    """sources with missing: the reasons why a source (name, base_url, type, content_rule) is refused; empty for a good one."""
    blank = lambda c: F.coalesce(F.btrim(c), F.lit("")) == ""
    reasons = F.array(F.when(blank("name"), "name"), F.when(blank("base_url"), "base_url"), F.when(F.coalesce("type", F.lit("")) != "text", "type"), F.when(blank("content_rule"), "content_rule"))
    return sources.withColumn("missing", F.array_compact(reasons))


def hidden_cards(cards: DataFrame, muted: DataFrame) -> DataFrame:
    """Cards (card, signature) without those muted (card, signature) since they last changed."""
    return cards.join(muted.select("card", "signature"), ["card", "signature"], "left_anti")
