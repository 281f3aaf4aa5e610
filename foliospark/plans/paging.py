"""Pages of many sources, round by round: a round asks each source that is still live for one page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


def paged(sources: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_pages: int = 10, max_attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Items (source_id, page, place, item) and ends (source_id, page, attempts, stopped_by, error) of sources (source_id).

    fetch gets (source_id, page, attempt) of a round and returns (source_id, error, items array<string>), a row for each that it can answer; it is asked for
    nothing else. A page that fails (an error, or no answer) keeps its number and is asked again, max_attempts times in a row; then the
    source has failed. A page without new items is the end (an empty one too), page max_pages is the cap. An item of a
    source stands once, where it came first. page is the last one that came; error the last one's, if no answer came after it. Each round is written, what
    stopped isn't looked at again.
    """
    live = written(sources.select("source_id").distinct().select("source_id", F.lit(1).alias("page"), F.lit(1).alias("attempt"), F.lit(0).cast("long").alias("attempts")))
    items, ends, rounds = None, None, 0
    while not live.isEmpty():
        rounds += 1
        answers = written(fetch(live.select("source_id", "page", "attempt")).select("source_id", "error", "items"))
        met = live.join(answers, "source_id", "left").withColumn("failed", F.col("items").isNull() | F.col("error").isNotNull())
        said = met.filter("NOT failed").select("source_id", "page", F.posexplode("items").alias("place", "item"))
        new = said.groupBy("source_id", "page", "item").agg(F.min("place").alias("place")).select("source_id", "page", "place", "item")
        new = written(new if items is None else new.join(items.select("source_id", "item"), ["source_id", "item"], "left_anti").select("source_id", "page", "place", "item"))
        items = new if items is None else items.union(new)
        if rounds % 8 == 0:  # the plan stays small
            items = written(items)
        n_new = new.groupBy("source_id").agg(F.count("*").alias("n_new"))
        why = (
            F.when(F.col("failed"), F.when(F.col("attempt") == max_attempts, "failed"))
            .when(F.col("n_new").isNull(), "end")
            .when(F.col("page") == max_pages, "cap")
        )
        state = written(met.join(n_new, "source_id", "left").select("source_id", "page", "attempt", (F.col("attempts") + 1).alias("attempts"), "failed", F.when(F.col("failed"), F.coalesce("error", F.lit("NO_ANSWER"))).alias("error"), why.alias("stopped_by")))
        over = state.filter("stopped_by IS NOT NULL").select("source_id", F.when(F.col("failed"), F.col("page") - 1).otherwise(F.col("page")).cast("long").alias("page"), "attempts", "stopped_by", "error")
        ends = over if ends is None else ends.union(over)
        go = state.filter("stopped_by IS NULL")
        live = go.select("source_id", F.when(F.col("failed"), F.col("page")).otherwise(F.col("page") + 1).alias("page"), F.when(F.col("failed"), F.col("attempt") + 1).otherwise(F.lit(1)).alias("attempt"), "attempts")
    if items is None:
        return sources.select("source_id", F.lit(0).alias("page"), F.lit(0).alias("place"), F.lit("").alias("item")).limit(0), live.select("source_id", F.col("page").cast("long").alias("page"), "attempts", F.lit("").alias("stopped_by"), F.lit("").alias("error"))
    return items, ends
