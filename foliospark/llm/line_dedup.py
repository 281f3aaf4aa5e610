"""Line dedup by site-relative frequency, with DataFrame functions only.

Lines are grouped by host and counted once for each page; a line's share is the number of the host's
pages that contain it over the host's pages. Lines above max_ratio, on min_pages pages at least, are
boilerplate there. A host has at most (mean lines a page) / max_ratio of them, so that they fit into one
array for each host; the table of these arrays is broadcast if it is small, else joined with a salt.

With distinct, equal texts of a host are one page: a line counts once for each distinct text, over the number of
the host's distinct texts, so that a text with many copies is no boilerplate by its copies alone. The pipeline
counts so; op3's query and its SQL count every copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join, written

MAX_RATIO, MIN_PAGES = 0.05, 5
_BLANK = " \t\r"


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """128 bits for a line without blanks at its ends."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.struct(F.xxhash64(F.lit(1), bare).alias("a"), F.xxhash64(F.lit(2), bare).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """host, keys: the boilerplate lines' keys of each host that has some, as a written table."""
    kept = F.filter(_lines(text), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    own = docs.select(F.coalesce(F.col(host), F.lit("")).alias("__host"), F.array_distinct(F.transform(kept, _key)).alias("keys"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    if distinct:  # one row of each text: only hashes and row numbers are summed up, and the lines' keys follow by number
        whole = [F.xxhash64(F.lit(k), "__text").alias(f"t{k}") for k in (3, 4)]
        own = written(own.select("__host", "keys", *whole, F.monotonically_increasing_id().alias("__row")))
        chosen = written(own.groupBy("__host", "t3", "t4").agg(F.min("__row").alias("__row")).select("__row"))
        own = own.join(chosen, "__row", "left_semi")
    lines = own.select("__host", F.explode("keys").alias("key"))
    counts = lines.groupBy("__host", "key.a", "key.b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    pages = written(own.groupBy("__host").agg(F.count("*").alias("pages")))
    often = lookup_join(counts, pages, "__host", "inner").filter(F.col("n") / F.col("pages") > max_ratio)
    return written(often.groupBy("__host").agg(F.collect_list(F.struct("a", "b")).alias("__keys")))


def dedup(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """docs without their hosts' boilerplate lines; adds n_lines and n_dropped (long), keeps all other columns and rows.

    Lines are compared without blanks, tabs and carriage returns at their ends; blank lines neither count
    nor go. A null text counts as empty (one blank line) and stays null; documents with a null host form
    one host, as the empty name does. Repeated rows are pages of their own, unless distinct is set: then equal
    texts of a host (null and empty ones too) are one page. A document may become empty. Texts and lines of any length are
    compared whole, by 128 bits. Columns of docs named n_lines, n_dropped, __host, __keys or __kept are replaced. Empty docs: empty result.
    """
    clash = {"__host", "__keys", "__kept", "n_lines", "n_dropped"} & set(docs.columns)
    docs = docs.drop(*clash)
    often = boilerplate(docs, host, text, max_ratio, min_pages, distinct)
    joined = lookup_join(docs.withColumn("__host", F.coalesce(F.col(host), F.lit(""))), often, "__host", elements=F.size("__keys"))
    kept = F.when(F.col("__keys").isNull(), _lines(text)).otherwise(F.filter(_lines(text), lambda x: ~F.array_contains(F.col("__keys"), _key(x))))
    joined = joined.withColumn("__kept", kept)
    n = F.size(_lines(text)).cast("long")
    joined = joined.withColumn("n_lines", n).withColumn("n_dropped", n - F.size("__kept"))
    return joined.withColumn(text, F.when(F.col(text).isNotNull(), F.concat_ws("\n", "__kept"))).drop("__host", "__keys", "__kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_line_dedup: the digest of every document's kept lines; the source is the host."""
    docs = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT host, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''))) AS line FROM d),
c AS (SELECT host, line, count(*) AS n FROM l GROUP BY host, line),
p AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
b AS (SELECT c.host, list(c.line) AS often FROM c JOIN p ON c.host = p.host
      WHERE n >= {MIN_PAGES} AND n::DOUBLE / pages::DOUBLE > {MAX_RATIO}::DOUBLE GROUP BY c.host),
k AS (SELECT doc_id, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(often, trim(x, ' ' || chr(9) || chr(13))), false)) AS kept
      FROM d LEFT JOIN b ON d.host = b.host)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM k
"""
