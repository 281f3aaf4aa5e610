"""Hits of many sources: relevance, merging by book, summaries, limits.

A hit has source_id, title, author, url, kind and arrival (a total order). Errors of sources are rows of
their own: (source_id, code, message).
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import DECORATION, relevance_key

#: Hits kept of a source, merged books returned, ranks.
HITS_OF_SOURCE, BOOKS = 50, 200
EXACT, CONTAINS, SUSPECT = 0, 1, 2


def _plain(keyword: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", keyword).lower() if c not in DECORATION)


def rank(keyword: str, title: Column, author: Column, kind: Column, compose: bool = True) -> Column:
    """0 exact, 1 contains, 2 suspect. An empty keyword makes all hits contain it; a keyword of several words may match by one of them in the title."""
    key = _plain(keyword)
    if not key:
        return F.lit(CONTAINS)
    t, a, k = (relevance_key(x, compose) for x in (title, author, kind))
    words = [w for w in map(_plain, re.split(r"\s+", keyword.strip())) if w and w != key]
    part = F.contains(t, F.lit(key)) | F.contains(a, F.lit(key)) | F.contains(k, F.lit(key))
    for w in words:
        part = part | F.contains(t, F.lit(w))
    return F.when((t == key) | (a == key), EXACT).when(part, CONTAINS).otherwise(SUSPECT)


def ranked(hits: DataFrame, keyword: str) -> DataFrame:
    return hits.withColumn("rank", rank(keyword, F.col("title"), F.col("author"), F.col("kind")))


def kept(hits: DataFrame, keyword: str) -> DataFrame:
    """Hits that aren't suspect, exact ones before the others (by rank and arrival)."""
    return ranked(hits, keyword).filter(F.col("rank") < SUSPECT)


def first_hits(hits: DataFrame, most: int = HITS_OF_SOURCE) -> DataFrame:
    """The first hits of each source."""
    w = Window.partitionBy("source_id").orderBy("arrival")
    return hits.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def _by_book(hits: DataFrame, keyword: str) -> DataFrame:
    """Hits that aren't suspect, with the compared title and author (no author is an author of its own)."""
    return kept(hits, keyword).withColumn("__t", relevance_key(F.col("title"))).withColumn("__a", relevance_key(F.col("author")))


def merge_books(hits: DataFrame, keyword: str) -> DataFrame:
    """One row for each book: the first arrival's title and author, the best rank, the first arrival, its sources and hits in number. book_hits has the hits themselves."""
    return (
        _by_book(hits, keyword)
        .groupBy("__t", "__a")
        .agg(
            F.min_by("title", "arrival").alias("title"),
            F.min_by("author", "arrival").alias("author"),
            F.min("rank").alias("rank"),
            F.min("arrival").alias("arrival"),
            F.count_distinct("source_id").alias("source_count"),
            F.count("*").alias("hits"),
        )
        .drop("__t", "__a")
    )


def book_hits(hits: DataFrame, keyword: str) -> DataFrame:
    """book (its first arrival), and arrival, source_id, title, author, url of each of its hits: a row for each, so that a book with very many (a blank title, say) is not gathered."""
    rows = _by_book(hits, keyword)
    books = rows.groupBy("__t", "__a").agg(F.min("arrival").alias("book"))
    return rows.join(books, ["__t", "__a"]).select("book", "arrival", "source_id", "title", "author", "url")


def top_books(books: DataFrame, most: int = BOOKS) -> DataFrame:
    """The best books (rank, more sources, earlier arrival)."""
    return books.orderBy("rank", F.desc("source_count"), "arrival").limit(most)


def round_summary(hits: DataFrame, sources: DataFrame, errors: DataFrame, keyword: str) -> DataFrame:
    """searched, answered, failed sources, and hits, kept, suspect of those that answered: one row."""
    failed = errors.select("source_id").distinct()
    answered = hits.join(failed, "source_id", "left_anti")
    marks = ranked(answered, keyword).agg(F.count("*").alias("hits"), F.count_if(F.col("rank") < SUSPECT).alias("kept"), F.count_if(F.col("rank") == SUSPECT).alias("suspect"))
    counts = sources.join(failed.withColumn("__f", F.lit(1)), "source_id", "left").agg(F.count("*").alias("searched"), F.count_if(F.col("__f").isNull()).alias("answered"), F.count("__f").alias("failed"))
    return counts.join(F.broadcast(marks), F.lit(True))


def occurrence(df: DataFrame, identity: list[str], order: str) -> DataFrame:
    """Adds occurrence: how many rows of the same identity stand before."""
    return df.withColumn("occurrence", (F.row_number().over(Window.partitionBy(*identity).orderBy(order)) - 1).cast("long"))


def first_of(df: DataFrame, identity: list[str], *order: str) -> DataFrame:
    """The first row of each identity."""
    w = Window.partitionBy(*identity).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def with_meta(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows (source_id, url) with the kind of the first hit at their address, where there is one."""
    meta = first_of(hits, ["source_id", "url"], "arrival").select("source_id", "url", F.col("kind").alias("meta_kind"))
    return rows.join(meta, ["source_id", "url"], "left")


def probe_verdicts(tries: DataFrame) -> DataFrame:
    """source_id, status, keyword: verified by the first keyword (in order) with an item whose first title isn't blank; else broken."""
    good = (F.col("items") >= 1) & (F.btrim("first_title") != "")
    out = tries.groupBy("source_id").agg(F.min_by(F.when(good, F.col("keyword")), F.when(good, F.col("ord"))).alias("keyword"))
    return out.select("source_id", F.when(F.col("keyword").isNotNull(), "verified").otherwise("broken").alias("status"), "keyword")
