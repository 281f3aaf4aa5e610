"""Shelf rows and reading positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shelf_filter(kind: str) -> Column:
    """all, reading (has progress), unread, local (no source)."""
    return {"all": F.lit(True), "reading": F.col("progress").isNotNull(), "unread": F.col("progress").isNull(), "local": F.col("source_id").isNull()}[kind]


def shelf_sort(shelf: DataFrame) -> DataFrame:
    """Newest first by update, then by addition, then by key."""
    return shelf.orderBy(F.desc_nulls_last("updated_at"), F.desc("added_at"), "book_key")


def current_item(positions: DataFrame, items: DataFrame, group: str) -> DataFrame:
    """positions (group, pos) with the item at each: the last in order that starts at or before it, the first one if none does.

    Items (group, ord, start); those without a start are holes. Both sides are laid out in one order, one shuffle
    and one sort for both, and each position takes the largest order before it, so that nothing is paired.
    """
    row = lambda df, at, kind: df.select(group, F.col(at).cast("double").alias("at"), (F.col("ord") if kind == 0 else F.lit(None)).cast("int").alias("ord"), F.lit(kind).cast("byte").alias("kind"))
    rows = row(items.filter("start IS NOT NULL"), "start", 0).union(row(positions, "pos", 1))
    by = Window.partitionBy(group).orderBy("at", "kind")
    before = F.max("ord").over(by.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("ord").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = rows.withColumn("item", F.coalesce(before, first)).filter("kind = 1")
    return found.select(group, F.col("at").alias("pos"), "item")


def next_missing(slots: DataFrame, group: str, position: int) -> DataFrame:
    """The first slot without a text at or after a position, for each group."""
    return slots.groupBy(group).agg(F.min(F.when((F.col("idx") >= position) & F.col("text").isNull(), F.col("idx"))).alias("next"))
