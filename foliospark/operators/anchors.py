"""References to places in documents: found by keys that degrade, in one ranked pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a reference leads to, best first.
KINDS = ("anchor", "near", "document", "degraded", "none")


def bound(references: DataFrame, documents: DataFrame, anchors: DataFrame, nearest: bool = False) -> DataFrame:
    """ref, kind, path, at of references (ref, path, fragment, nav) to documents (path) and their anchors (path, fragment, at, kept).

    A fragment that is a kept anchor leads there (anchor; the first one of its name). Without a fragment, or with an empty one, a
    reference leads to the document's beginning (document). A fragment that isn't there, or whose element was taken out, is
    degraded to the beginning for navigation, and none for links in a text; with nearest, an element taken out
    leads to the kept anchor before it, if there is one (near). No path, or one of no document, is none.
    Every reference asks for (path, fragment) and for the path alone; the better answer stays. Repeated refs are one.
    """
    in_order = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = F.last(F.when(F.col("kept"), F.col("at")), ignorenulls=True).over(in_order) if nearest else F.lit(None).cast(anchors.schema["at"].dataType)
    placed = anchors.select("path", "fragment", "kept", "at", before.alias("near"))
    first = placed.groupBy("path", "fragment").agg(F.min(F.struct((~F.col("kept")).alias("gone"), "at", "near")).alias("a"))
    there = first.select("path", "fragment", F.when(~F.col("a.gone"), F.lit(0)).when(F.col("a.near").isNotNull(), F.lit(1)).alias("rank"), F.when(~F.col("a.gone"), F.col("a.at")).otherwise(F.col("a.near")).alias("at"))
    whole = documents.select("path").distinct().select("path", F.lit("").alias("fragment"), F.lit(2).alias("rank"), F.lit(None).cast(anchors.schema["at"].dataType).alias("at"))
    targets = there.filter("rank IS NOT NULL AND fragment <> ''").unionByName(whole)
    asked = references.select("ref", "path", F.coalesce("fragment", F.lit("")).alias("fragment"), "nav")
    keys = asked.select("ref", "nav", "path", F.col("fragment").alias("own"), F.explode(F.array_distinct(F.array("fragment", F.lit("")))).alias("fragment"))
    met = keys.join(targets, ["path", "fragment"])
    # the document alone, where a fragment was asked for
    rank = F.when((F.col("rank") == 2) & (F.col("own") != ""), F.when(F.col("nav"), F.lit(3)).otherwise(F.lit(4))).otherwise(F.col("rank"))
    found = met.select("ref", rank.alias("rank"), "path", "at").filter("rank < 4")
    none = references.select("ref", F.lit(4).alias("rank"), F.lit(None).cast("string").alias("path"), F.lit(None).cast(anchors.schema["at"].dataType).alias("at"))
    best = found.unionByName(none).groupBy("ref").agg(F.min_by(F.struct("rank", "path", "at"), F.struct("rank", "path", "at")).alias("b"))
    return best.select("ref", F.get(F.array(*map(F.lit, KINDS)), F.col("b.rank")).alias("kind"), F.col("b.path").alias("path"), F.col("b.at").alias("at"))
