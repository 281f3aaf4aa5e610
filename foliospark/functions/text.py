"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that don't count when titles and names are compared.
DECORATION = " \t\n\r\f\v 　《》〈〉「」『』【】[]()（）｛｝·、,，.。:：;；!！?？-—–_~*'\"“”‘’/\\|+"
#: White space at which a text is trimmed.
WHITE = " \t\n\r\f\v 　﻿"


def clean_text(x: Column) -> Column:
    """Ideographic blanks count as blanks; runs of blanks, tabs and line ends become one blank; trimmed."""
    return F.btrim(F.regexp_replace(F.translate(x, "　", " "), r"[ \t\r\n]+", " "), F.lit(" "))


def chapter_text(x: Column) -> Column:
    """Each line trimmed, blank lines at both ends dropped, runs of blank lines made one. Applying it twice changes nothing."""
    lines = F.transform(F.split(x, "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)))
    joined = F.array_join(lines, "\n")
    return F.btrim(F.regexp_replace(joined, "\n{3,}", "\n\n"), F.lit("\n"))


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def relevance_key(x: Column, compose: bool = True) -> Column:
    """What titles and names are compared by: compatibility characters folded (in a pandas UDF; not without compose), lower case, without decoration."""
    x = F.coalesce(x, F.lit(""))
    # ASCII texts, which it doesn't change, don't go to Python
    composed = F.coalesce(nfkc(F.when(~x.rlike(r"^\p{ASCII}*$"), x)), x) if compose else x
    return F.translate(F.lower(composed), DECORATION, "")


def is_true(x: Column) -> Column:
    """A rule's text as a boolean: null, blank, null, false, no, not, 0 and 0.0 are false."""
    return F.coalesce(~F.lower(F.btrim(x, F.lit(WHITE))).isin("", "null", "false", "no", "not", "0", "0.0"), F.lit(False))


def groups(x: Column) -> Column:
    """The distinct names of a list that commas (half or full width) or backslashes separate."""
    parts = F.transform(F.split(x, r"[,，\\]", -1), lambda p: F.btrim(p, F.lit(WHITE)))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def dedup_key(x: Column) -> Column:
    """An address without blanks around it and slashes at its end."""
    return F.rtrim(F.btrim(x, F.lit(WHITE)), F.lit("/"))


def short_author(x: Column) -> Column:
    """At most two of a list of names."""
    names = F.filter(F.transform(F.split(x, "[,，、]", -1), lambda p: F.btrim(p, F.lit(WHITE))), lambda p: p != "")
    return F.array_join(F.slice(names, 1, 2), ",")


def word_count_label(x: Column) -> Column:
    """A count as it is shown: whole numbers get a unit, over 10,000 in ten thousands with one half-even decimal; other texts stay."""
    n = x.try_cast("bigint")
    # a cast to float that is cast again at once is optimised away, and with it the rounding to a float
    single = (n.cast("float") * F.lit(1.0).cast("float")).cast("double")
    tens = F.bround(single / 10000, 1)
    label = F.when(n <= 0, "").when(n <= 10000, F.concat(n.cast("string"), F.lit("字"))).otherwise(F.concat(F.regexp_replace(F.format_string("%.1f", tens), r"\.0$", ""), F.lit("万字")))
    return F.when(x.rlike("^-?[0-9]+$"), label).otherwise(x)


def kind_label(items: Column, most: int = 1000) -> Column:
    """Kinds joined by commas, cut at a number of characters."""
    return F.left(F.array_join(items, ","), F.lit(most))


def is_spoken(x: Column) -> Column:
    """False for texts of blanks, punctuation, symbols and control characters alone."""
    return ~x.rlike(r"^[\s\p{C}\p{P}\p{Z}\p{S}]*$")


def page_choice(x: Column, page: Column) -> Column:
    """Replaces the first list <a,b,c> by its entry for the page, the last one beyond its end; a null page changes nothing."""
    inner = F.regexp_extract(x, "<([^<>]*)>", 1)
    parts = F.split(inner, ",", -1)
    chosen = F.btrim(F.element_at(parts, F.least(page, F.size(parts))), F.lit(" "))
    cut = F.instr(x, "<")
    return F.when(page.isNull() | ~x.rlike("<[^<>]*>"), x).otherwise(F.concat(F.substring(x, F.lit(1), cut - 1), chosen, F.substring(x, cut + F.length(inner) + 2, F.length(x))))


def url_option(x: Column) -> Column:
    """The JSON object that follows an address after a comma; empty without one."""
    return F.regexp_extract(x, r"(?s),\s*(\{.*)$", 1)


def without_option(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\s*,\s*\{.*$", "")


#: Elements that begin and end lines, others that a text may have, and the form of attributes.
BLOCK_TAGS = tuple("p div li ul ol h1 h2 h3 h4 h5 h6 blockquote section article aside header footer nav main table thead tbody tfoot tr td th figure figcaption dl dt dd pre hr form fieldset address".split())
INLINE_TAGS = tuple("br span a em strong b i u s font img sub sup small code mark wbr".split())
ATTRIBUTES = r"""(?:\s+[a-zA-Z_:][-\w:.]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*"""


def looks_like_html(x: Column) -> Column:
    """Whether the tag of a known element, with attributes in their form, stands in the text."""
    return x.rlike(rf"(?i)</?(?:{'|'.join((*BLOCK_TAGS, *INLINE_TAGS))}){ATTRIBUTES}\s*/?>")


def closed_references(html: Column) -> Column:
    """HTML in which only references that end with a semicolon are read as such: the & of others, as of &amp cut short, is written as &amp; (in scripts, too).

    HTML5 also decodes some old names without the semicolon.
    """
    return F.regexp_replace(html, "&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)", "&amp;")


#: Elements that begin a line of an introduction (by the beginning of their names), entities and characters that are blanks or nothing.
INTRO_LINES = r"div|p|br|hr|h\d|article|dd|dl"
INTRO_BLANKS = "(?:&nbsp;)+|&ensp;|&emsp;"
INTRO_COMMENTS, INTRO_ELEMENTS = r"<!--[^>]*-->", r"</?[a-zA-Z]+(?=[ >])[^<>]*>"
INTRO_NOTHING = "&thinsp;|&zwnj;|&zwj;|[\u2009\u200c\u200d]"
INDENT = "\u3000\u3000"


def intro(x: Column, most: int = 5000) -> Column:
    """An introduction as plain text: its lines are what stands between line ends and elements that begin lines, without other
    elements and comments, trimmed, each indented, blank ones left out; cut at `most` characters. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(x, INTRO_BLANKS, " "), INTRO_NOTHING, "")
    lines = F.split(bare, rf"(?:</?(?:{INTRO_LINES})[^>]*>|\n)", -1)
    shown = F.transform(lines, lambda line: F.btrim(F.regexp_replace(line, f"{INTRO_COMMENTS}|{INTRO_ELEMENTS}", ""), F.lit(WHITE)))
    return F.left(F.array_join(F.transform(F.filter(shown, lambda line: line != ""), lambda line: F.concat(F.lit(INDENT), line)), "\n"), F.lit(most))


#: Names of entities that content is decoded by; others stay.
CONTENT_ENTITIES = {
    "nbsp": "\u00a0", "ensp": "\u2002", "emsp": "\u2003", "thinsp": "\u2009", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'",
    "ldquo": "\u201c", "rdquo": "\u201d", "lsquo": "\u2018", "rsquo": "\u2019", "mdash": "\u2014", "ndash": "\u2013", "hellip": "\u2026", "middot": "\u00b7",
    "copy": "\u00a9", "reg": "\u00ae", "times": "\u00d7", "divide": "\u00f7", "laquo": "\u00ab", "raquo": "\u00bb", "bull": "\u2022", "dagger": "\u2020",
}


def _entity(m: re.Match) -> str:
    name = m[1]
    if name[0] != "#":
        return CONTENT_ENTITIES.get(name.lower(), m[0])
    digits = name[2:].lstrip("0") if name[1] in "xX" else name[1:].lstrip("0")
    code = int(digits or "0", 16 if name[1] in "xX" else 10) if len(digits) < 9 else 0x110000
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


@F.pandas_udf(T.StringType())
def content_decoded(x: pd.Series) -> pd.Series:
    """Numeric entities and those of CONTENT_ENTITIES as characters. Only texts with & are looked at."""
    entity = re.compile(r"&(#[xX][0-9a-fA-F]+|#\d+|[a-zA-Z][a-zA-Z0-9]{1,8});")
    return x.map(lambda s: entity.sub(_entity, s) if s and "&" in s else s)
