"""Numbers, times, digests and addresses as column expressions."""

from __future__ import annotations

import base64
import codecs
import hashlib
import hmac as _hmac
import re
from urllib.parse import quote, unquote_to_bytes, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binding import let

#: Numerals and their values.
DIGITS = {"零": 0, "〇": 0, "一": 1, "壹": 1, "二": 2, "贰": 2, "两": 2, "三": 3, "叁": 3, "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陆": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9}
UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000, "万": 10**4, "萬": 10**4, "亿": 10**8}


_STEP = re.compile(f"([{''.join(DIGITS)}]*)([{''.join(u for u, n in UNITS.items() if n <= 1000)}]?)")


def _written_digits(text: str) -> int:
    """Digits in a row as a decimal number; none are 0."""
    return int("".join(str(DIGITS[c]) for c in text) or 0)


def _amount(text: str) -> int:
    """The last great unit cuts a numeral in two; what has none is a sum of digits with small units."""
    for great in "亿万":
        head, mark, tail = text.rpartition(great)
        if mark:
            return _amount(head) * UNITS[great] + _amount(tail)
    return sum((_written_digits(n) or 1) * UNITS[unit] if unit else _written_digits(n) for n, unit in _STEP.findall(text))


def numeral(text: str) -> int:
    """The number that Chinese numerals name; -1 if a character is none. A last digit right after a unit over ten counts tenths of it."""
    text = text.replace("萬", "万")
    if not set(text) <= DIGITS.keys() | UNITS.keys():
        return -1
    unit = UNITS.get(text[-2], 0) if len(text) > 2 and text[-1] in DIGITS else 0
    return _amount(text[:-1]) + DIGITS[text[-1]] * unit // 10 if unit > 10 else _amount(text)


@F.pandas_udf(T.LongType())
def numeral_value(x: pd.Series) -> pd.Series:
    """numeral() of a column."""
    return x.map(lambda s: None if s is None else numeral(s)).astype("Int64")


#: Full-width digits, and the plain ones.
_WIDE, _DIGITS = "０１２３４５６７８９", "0123456789"


def whole_number(x: Column) -> Column:
    """A text as a whole number: digits (full-width ones too, with blanks between), else Chinese numerals; -1 for an empty one and where neither is found."""
    bare = F.regexp_replace(F.translate(x, _WIDE, _DIGITS), r"\s+", "")
    return F.when(bare == "", F.lit(-1)).when(bare.rlike(r"^-?\d+$"), bare.try_cast("long")).otherwise(numeral_value(bare))


def numbered_title(x: Column) -> Column:
    """A title with the number of its first 第…章 in plain digits; other titles as they are."""
    shape = r"^(?s)(.*?第)(.+?)(章.*)$"
    return F.when(x.rlike("第.+?章"), F.concat(F.regexp_extract(x, shape, 1), whole_number(F.regexp_extract(x, shape, 2)).cast("string"), F.regexp_extract(x, shape, 3))).otherwise(x)


def format_time(ms: Column) -> Column:
    """A time in milliseconds as yyyy/MM/dd HH:mm; empty where there is none."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy/MM/dd HH:mm"), F.lit(""))


def md5_middle(x: Column) -> Column:
    """The middle 16 digits of an MD5."""
    return F.substring(F.md5(x), 9, 16)


def epoch_key(*fields: Column) -> Column:
    """Ten hex digits that change with any of the ordered fields."""
    return F.left(F.sha1(F.concat_ws("\0", *[F.coalesce(f, F.lit("")) for f in fields])), F.lit(10))


def from_hex(x: Column) -> Column:
    """Text from hex digits; empty for what isn't hex."""
    return F.when(x.rlike("^(?:[0-9a-fA-F]{2})*$"), F.unhex(x).cast("string")).otherwise("")


def hmac_hex(x: Column, key: str, algorithm: str = "sha256") -> Column:
    """HMAC, which Spark has no function for."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else _hmac.new(key.encode(), t.encode(), algorithm).hexdigest())

    return run(x)


def digest_base64(x: Column, algorithm: str) -> Column:
    """A digest by name (md5, sha1, sha256, sha3_256, ...) in base 64; an unknown name is an error at once."""
    hashlib.new(algorithm)

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else base64.b64encode(hashlib.new(algorithm, t.encode()).digest()).decode())

    return run(x)


@F.pandas_udf(T.StringType())
def uri_component(x: pd.Series) -> pd.Series:
    """Percent-encoding of a component: a blank is %20, and !'()*~ stay."""
    return x.map(lambda s: None if s is None else quote(s, safe="!'()*~"))


@F.pandas_udf(T.StringType())
def absolute_url(x: pd.Series, base: pd.Series) -> pd.Series:
    """An address in full; null for an empty one, a script or one with a line end or tab within."""

    def one(u: str | None, b: str | None) -> str | None:
        u = (u or "").strip()
        if not u or u.lower().startswith("javascript:") or any(c in u for c in "\t\n\r"):
            return None
        return urljoin(b or "", u)

    return pd.Series([one(u, b) for u, b in zip(x, base, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _normalised(x: pd.Series, base: pd.Series) -> pd.Series:
    def one(u: str | None, b: str | None) -> str | None:
        if u is None:
            return None
        try:
            parts = urlsplit(urljoin(b or "", u.strip()))
            if not parts.scheme or not parts.hostname:
                return u
            port = "" if parts.port in (None, {"http": 80, "https": 443}.get(parts.scheme)) else f":{parts.port}"
            user = f"{parts.netloc.rpartition('@')[0]}@" if "@" in parts.netloc else ""
            host = parts.hostname.encode("idna").decode() if not parts.hostname.isascii() else parts.hostname
            kept = lambda s: quote(s, safe="/:@!$&'()*+,;=%?~|[]^")
            return urlunsplit((parts.scheme, user + host + port, kept(parts.path) or "/", kept(parts.query), kept(parts.fragment)))
        except ValueError:
            return u

    return pd.Series([one(u, b) for u, b in zip(x, base, strict=True)], dtype=object)


def canonical_url(x: Column, base: Column | None = None) -> Column:
    """An address as it is compared: without its option object, in full, scheme and host in lower case, without a default port; what is no address stays."""
    return _normalised(F.regexp_replace(x, r"(?s)\s*,\s*\{.*$", ""), F.lit(None).cast("string") if base is None else base)


def form_in_charset(x: Column, charset: str) -> Column:
    """A form's text with its percent-encoded UTF-8 in another character set; runs that aren't UTF-8, or have no place in it, stay."""
    codec = codecs.lookup("gb18030" if charset.lower() in ("gbk", "gb2312") else charset).name

    def again(m: re.Match) -> str:
        try:
            return "".join(f"%{b:02X}" for b in unquote_to_bytes(m[0]).decode().encode(codec))
        except (UnicodeDecodeError, UnicodeEncodeError):
            return m[0]

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else re.sub("(?:%[0-9A-Fa-f]{2})+", again, t))

    return run(x)


def safe_key(x: Column) -> Column:
    """A component for file names: a long one is cut and gets ten digits of its SHA-1."""
    full = uri_component(x)
    return F.when(F.length(full) <= 100, full).otherwise(F.concat(F.left(full, F.lit(60)), F.lit("~"), F.left(F.sha1(x), F.lit(10))))


#: Names of a query's parameters that page through one chapter.
PAGING = ("page", "p", "pg", "pn", "pageno", "pagenum", "page_no", "page_num", "pageindex", "page_index", "页码")


def same_chapter(url: Column, base: Column) -> Column:
    """Whether an address in full is another page of the chapter at base: same origin, and the same path with a paging query only, or a path that goes on."""
    origin = lambda u: F.lower(F.regexp_extract(u, r"^([a-zA-Z]+://[^/?#]*)", 1))
    path = lambda u: F.regexp_replace(F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), r"\.[A-Za-z0-9]+$", "")
    query = lambda u: F.regexp_extract(u, r"\?([^#]*)", 1)
    paging = query(url).rlike(f"(?i)^(?:(?:{'|'.join(PAGING)})(?:=[^&]*)?(?:&|$))+$")
    equal = (path(url) == path(base)) & ((query(url) == query(base)) | ((query(base) == "") & paging))
    return (origin(url) == origin(base)) & (equal | ((path(url) != path(base)) & (query(url) == "") & F.startswith(path(url), path(base))))


def cookies(x: Column) -> Column:
    """A cookie header as a map of names and values; the last of equal names wins, parts without a name go."""
    parts = F.filter(F.transform(F.split(x, ";", -1), lambda p: F.btrim(p)), lambda p: F.instr(p, "=") > 1)
    named = F.transform(parts, lambda p, i: F.struct(F.btrim(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), F.btrim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))
    # in order of names and places, the last of a name is the one before another name
    kept = let(F.array_sort(named), lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i + 1)["k"] != e["k"], F.lit(True))))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"], e["v"])))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def progress_percent(chapter: Column, ratio: Column, total: Column) -> Column:
    """Percent read, rounded half up, 100 at most; null while the total is unknown."""
    return F.when(total > 0, F.least(F.lit(100), F.floor((chapter + ratio) / total * 100 + 0.5))).cast("long")


def source_kind(code: Column) -> Column:
    """A source's type by its number."""
    return F.when(code.isNull() | code.isin(0, -1), "text").when(code == 1, "audio").when(code == 2, "image").when(code == 3, "file").otherwise("unknown")
