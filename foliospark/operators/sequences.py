"""Operators on ordered rows: chapters, running sums, eviction, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: heading lines of chapters.
HEADING = r"^\s*(?:第[0-9零一二三四五六七八九十百千万亿两壹贰叁肆伍陆柒捌玖拾佰仟萬億]+[章卷回节集部篇]|[章卷回节集部篇][0-9零一二三四五六七八九十百千万亿两壹贰叁肆伍陆柒捌玖拾佰仟萬億]+|序章|楔子|番外|尾声|后记|Chapter\s*\d+)\s*[:：.、\s]*.*$"
PREFACE = "正文"


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 0), line, start: a text's lines and the number of characters before each."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("long"))


def chapters(docs: DataFrame, key: str = "doc_id", text: str = "text", heading: str = HEADING) -> DataFrame:
    """key, idx, name, start, end: spans of characters between heading lines.

    What stands before the first heading is a chapter of its own unless it is blank; a text without
    headings is one chapter.
    """
    rows = lines(docs, key, text).withColumn("bare", F.regexp_replace("line", "\r$", ""))
    is_head = F.col("bare").rlike(heading)
    by_key = Window.partitionBy(key)
    rows = rows.withColumn("length", F.max(F.col("start") + F.length("line")).over(by_key)).withColumn("n_heads", F.count_if(is_head).over(by_key))
    first = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prose", F.coalesce(F.bool_or(F.btrim("bare") != "").over(first), F.lit(False)))
    heads = rows.filter(is_head)
    order = Window.partitionBy(key).orderBy("line_no")
    heads = heads.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("start").over(order))
    own = heads.select(key, "line_no", F.btrim("bare").alias("name"), (F.col("start") + F.length("line") + 1).alias("start"), F.coalesce(F.col("next") - 1, "length").alias("end"))
    preface = heads.filter("n = 1 AND prose").select(key, F.lit(-1).alias("line_no"), F.lit(PREFACE).alias("name"), F.lit(0).cast("long").alias("start"), (F.col("start") - 1).alias("end"))
    whole = rows.filter("n_heads = 0 AND line_no = 0").select(key, "line_no", F.lit(PREFACE).alias("name"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))
    spans = own.union(preface).union(whole)
    return spans.withColumn("idx", (F.row_number().over(order) - 1).cast("long")).select(key, "idx", "name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def starts_before(rows: DataFrame, partition: list[str], order: list[str], amount: str, name: str = "start") -> DataFrame:
    """The sum of the amounts before each row."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("long"))


def first_start(rows: DataFrame, partition: list[str], node: str, start: str = "start") -> DataFrame:
    """The least start of each node."""
    return rows.filter(F.col(node).isNotNull()).groupBy(*partition, node).agg(F.min(start).alias(start))


def pruned(entries: DataFrame, partition: str, most: int | Column) -> DataFrame:
    """Entries (partition, entry, mtime, size, reserved) that go, oldest first, until the rest is within the limit.

    Reserved ones are passed over. Each partition is a store of its own.
    """
    total = F.sum("size").over(Window.partitionBy(partition))
    rows = entries.withColumn("__total", total).filter(~F.col("reserved"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(partition).orderBy("mtime", "entry").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = most if isinstance(most, Column) else F.lit(most)
    return rows.withColumn("__before", before).filter(F.col("__total") - F.col("__before") > most).drop("__total", "__before")


def newest(rows: DataFrame, partition: str, order: str, each: int, overall: int) -> DataFrame:
    """The newest rows of each partition, and of those the newest overall (a bounded limit)."""
    w = Window.partitionBy(partition).orderBy(F.desc(order))
    own = rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= each).drop("__n")
    return own.orderBy(F.desc(order)).limit(overall)


def sent_order(cookies: DataFrame, jar: str, path: str, order: str) -> DataFrame:
    """cookies with place (from 1): the order in which a jar's are sent, longer paths first, then as they came."""
    w = Window.partitionBy(jar).orderBy(F.desc(F.length(path)), order)
    return cookies.withColumn("place", F.row_number().over(w))


def tail(rows: DataFrame, partition: str, order: str, size: str, most: int) -> DataFrame:
    """The last rows of each partition whose sizes sum up to the limit at most; the very last one always. Adds offset, the bytes before it from the beginning."""
    rows = starts_before(rows, [partition], [order], size, "offset")
    w = Window.partitionBy(partition).orderBy(F.desc(order))
    kept = rows.withColumn("__after", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    return kept.filter((F.col("__after") <= most) | (F.col("__n") == 1)).drop("__after", "__n")


def read_tail(kept: DataFrame, partition: str, size: str, offset: int) -> DataFrame:
    """What a reader at an offset gets of tail(): rows that end after it, and lossy where earlier ones are gone."""
    head = F.min("offset").over(Window.partitionBy(partition))
    return kept.withColumn("lossy", F.lit(offset) < head).filter(F.col("offset") + F.col(size) > offset)


def joined_in_order(rows: DataFrame, group: str, order: str, text: str, separator: str = "\n") -> DataFrame:
    """Texts of a group joined in order."""
    return rows.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda e: e[text]), separator).alias(text))


def export_range(chapters_: DataFrame, group: str, first: int, last: int) -> DataFrame:
    """Chapters first to last (idx, name, text) as one text for each group, up to the first without a text, which leaves a mark."""
    w = Window.partitionBy(group).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = chapters_.filter(F.col("idx").between(first, last)).withColumn("__missing", F.count_if(F.col("text").isNull()).over(w))
    rows = rows.filter((F.col("__missing") == 0) | ((F.col("__missing") == 1) & F.col("text").isNull()))
    part = F.concat("name", F.lit("\n\n"), F.coalesce("text", F.lit("[missing]")))
    return joined_in_order(rows.withColumn("text", part), group, "idx", "text", "\n\n")
