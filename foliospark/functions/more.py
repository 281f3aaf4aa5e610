"""Entities, character sets, guarded patterns, ciphers, header maps, labels and reading positions."""

from __future__ import annotations

import codecs
import html
import re

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binding import let

#: A pattern's time, by the length of the text.
BASE_MS, MS_FOR_MIB, MOST_MS = 200, 100, 1200


@F.pandas_udf(T.StringType())
def unescaped(x: pd.Series) -> pd.Series:
    """Numeric and named entities as characters; unknown ones stay. Only texts with & are looked at."""
    return x.map(lambda s: html.unescape(s) if s and "&" in s else s)


def guarded_replace(x: Column, pattern: str, replacement: str = "") -> Column:
    """A global replacement by a pattern of unknown origin: one that takes too long on a text is an error, not a stuck task."""
    template = re.sub(r"\$(\d)", r"\\g<\1>", replacement.replace("\\", "\\\\"))

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        compiled = regex.compile(pattern)
        limit = lambda t: min(MOST_MS, BASE_MS + MS_FOR_MIB * len(t) / 2**20) / 1000
        return s.map(lambda t: None if t is None else compiled.sub(template, t, timeout=limit(t)))

    return run(x)


@F.pandas_udf(T.StringType())
def _decoded_by_name(content: pd.Series, name: pd.Series) -> pd.Series:
    def one(b: bytes | None, n: str | None) -> str | None:
        return None if b is None or n is None else codecs.lookup("gb18030" if n in ("gbk", "gb2312") else n).decode(b, "replace")[0]

    return pd.Series([one(*r) for r in zip(content, name, strict=True)], dtype=object)


def charset_of(content: Column, declared: Column, content_type: Column) -> Column:
    """The character set of a page's bytes, in lower case: the declared one, that of its content type, of a meta element in its first 1024 bytes, else utf-8."""
    head = F.decode(F.substring(content, 1, 1024), "iso-8859-1")
    named = lambda x, pattern: F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), pattern, 1), F.lit(""))
    charset = r"charset=[\"']?([\w-]+)"
    return F.lower(F.coalesce(F.nullif(declared, F.lit("")), named(content_type, "(?i)" + charset), named(head, "(?i)<meta[^>]+" + charset), F.lit("utf-8")))


def page_text(content: Column, declared: Column, content_type: Column) -> Column:
    """Text of a page's bytes by charset_of. UTF-8 that is whole is Spark's cast; bytes of other sets, or broken ones, go through Python. An unknown name is an error."""
    name = charset_of(content, declared, content_type)
    plain = (name == "utf-8") & F.is_valid_utf8(content.cast("string"))
    return F.when(plain, content.cast("string")).otherwise(_decoded_by_name(F.when(~plain, content), F.when(~plain, name)))


def is_detail(url: Column, pattern: Column) -> Column:
    """Whether a whole address matches a source's pattern; false without one."""
    return F.coalesce((F.btrim(pattern) != "") & F.regexp_like(url, F.concat(F.lit("^(?:"), pattern, F.lit(")$"))), F.lit(False))


def aes_text(x: Column, key: Column) -> Column:
    """Text of base 64 AES/CBC/PKCS5 with the initial vector in the first 16 bytes; null for what can't be decrypted."""
    return F.try_aes_decrypt(F.unbase64(x), key, F.lit("CBC"), F.lit("PKCS")).cast("string")


def merged_headers(low: Column, high: Column) -> Column:
    """Two maps of headers as one; names are compared in lower case, and the second map wins."""
    lower = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    return put(lower(low), lower(high))


def put(variables: Column, new: Column) -> Column:
    """Variables with new ones put over them; null values aren't stored."""
    return let(F.map_filter(new, lambda k, v: v.isNotNull()), lambda n: F.map_concat(F.map_filter(variables, lambda k, v: ~F.map_contains_key(n, k)), n))


def got(name: str, *scopes: Column) -> Column:
    """A variable from the first scope in which it isn't empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(s, F.lit(name)), F.lit("")) for s in scopes])


def without_nulls(row: Column) -> Column:
    """JSON of a row without its null fields."""
    return F.to_json(row)


def without_icons(x: Column) -> Column:
    """A name without the symbols at its beginning, unless nothing else is there."""
    rest = F.regexp_replace(x, r"^[\p{So}\p{Sk}\x{FE0F}\x{200D}\s]+", "")
    return F.when(rest == "", x).otherwise(rest)


def icon(x: Column) -> Column:
    """The first run of symbols in a name."""
    return F.regexp_extract(x, r"([\p{So}\p{Sk}\x{FE0F}\x{200D}]+)", 1)


def ratio_within(pos: Column, start: Column, height: Column) -> Column:
    """How far a position is into an item, between 0 and 1."""
    return F.when(height > 0, F.least(F.greatest((pos - start) / height, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def paragraph_at(ratio: Column, n: Column) -> Column:
    """The paragraph (from 0) at a ratio; both ends are met, halves go up."""
    return F.when(n <= 1, 0).otherwise(F.floor(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)) * (n - 1) + 0.5)).cast("long")


def ratio_of(paragraph: Column, n: Column) -> Column:
    return F.when(n <= 1, F.lit(0.0)).otherwise(paragraph / (n - 1))


def sheet_keyword(title: Column, author: Column) -> Column:
    """Title and author as one keyword, what is there of them."""
    part = lambda x: F.nullif(F.btrim(x), F.lit(""))
    return F.concat_ws(" ", part(title), part(author))


def receipts(wanted: DataFrame, landed: DataFrame) -> DataFrame:
    """seats, landed, missing, unaddressed: distinct addresses wanted, those landed and not, and rows without one: one row."""
    seats = wanted.filter("url IS NOT NULL").select("url").distinct()
    there = landed.select("url").distinct().withColumn("__l", F.lit(1))
    counts = seats.join(there, "url", "left").agg(F.count("*").alias("seats"), F.count("__l").alias("landed"), F.count_if(F.col("__l").isNull()).alias("missing"))
    return counts.join(F.broadcast(wanted.agg(F.count_if(F.col("url").isNull()).alias("unaddressed"))), F.lit(True))
