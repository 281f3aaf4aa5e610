"""Sources: pages as trees of nodes, texts of unknown encoding, books of text files."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import small_batches, spread, written

#: Fixed values of HTML: elements without content, and elements that end an open one of the same group.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: Rows that a batch of nodes or elements has before it goes; only a page of more is in one batch as a whole.
MOST_ROWS = 5_000

NODES = "page_id long, node_id int, parent_id int, ord int, depth int, subtree_end int, tag string, attrs map<string,string>, text string, path array<int>"


_NAMES = ["page_id", "node_id", "parent_id", "ord", "depth", "subtree_end", "tag", "attrs", "text", "path"]


class _Tree(HTMLParser):
    """Rows (parent, ord, depth, tag, attributes, text) in document order; texts have no tag.

    Known differences from a tree by HTML5's rules: html, head, body and tbody are not implied, contents of tables that belong
    elsewhere are not moved before them, misnested formatting elements are not repeated, and foreign elements (svg,
    math) keep no case.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.children: dict[int, int] = {}

    def _add(self, tag: str | None, attrs: dict, text: str | None) -> int:
        parent = self.open[-1] if self.open else -1
        n = self.children[parent] = self.children.get(parent, -1) + 1
        self.rows.append([parent, n, len(self.open), tag, attrs, text, len(self.rows), list(self.open)])
        return len(self.rows) - 1

    def _close(self, k: int) -> None:
        for i in self.open[k:]:
            self.rows[i][6] = len(self.rows) - 1
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        ends = _ENDS.get(tag, {"p"} if tag in _BLOCKS else set())
        stops = _STOPS.get(tag, set())
        for k in range(len(self.open) - 1, -1, -1):
            other = self.rows[self.open[k]][3]
            if other in ends:
                self._close(k)
                break
            if other in stops or (tag not in _STOPS and other in _BLOCKS):
                break
        own: dict[str, str] = {}
        for a, v in attrs:
            own.setdefault(a, v or "")
        i = self._add(tag, own, None)
        if tag not in VOID:
            self.open.append(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]][3] == tag:
                self._close(k)
                return

    def handle_data(self, data):
        if self.rows and self.open and self.rows[-1][3] is None and self.rows[-1][0] == self.open[-1]:
            self.rows[-1][5] += data
        else:
            self._add(None, {}, data)


def _trees(batch: pa.RecordBatch) -> Iterator[tuple[int | None, _Tree]]:
    """Each page's key and tree, one at a time."""
    for page, text in zip(*batch.columns, strict=True):
        tree = _Tree()
        tree.feed(text.as_py() or "")
        tree.close()
        tree._close(0)
        yield page.as_py(), tree


def _sent(out: list[list], kinds: tuple[pa.DataType, ...], names: list[str]) -> pa.RecordBatch:
    """The columns as a batch; they are empty afterwards."""
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
    for column in out:
        column.clear()
    return batch


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Each page's tree as rows, numbered in document order: the nodes below one are those up to its subtree_end, and path names
    those above it.

    Pages without an end, unclosed and stray tags are read as far as they go. A null page has no nodes.
    """

    kinds = (pa.int64(), *[pa.int32()] * 5, pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for page, tree in _trees(batch):
                for i, (parent, n, depth, tag, attrs, data, end, path) in enumerate(tree.rows):
                    for column, x in zip(out, (page, i, parent, n, depth, end, tag, list(attrs.items()), data, path), strict=True):
                        column.append(x)
                if len(out[0]) >= MOST_ROWS:
                    yield _sent(out, kinds, _NAMES)
            if out[0]:
                yield _sent(out, kinds, _NAMES)

    small_batches(pages.sparkSession)
    return pages.select(F.col(key).cast("long"), html).mapInArrow(run, NODES)


CHAINS = "page_id long, node_id int, subtree_end int, attrs map<string,string>, own_text string, chain array<struct<node: int, tag: string, cls: string, id: string, nth: int, n_same: int, place: int, n_all: int>>"


def element_chains(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Each page's elements with the text directly in them and their chain, from the top of the page down to themselves.

    A link of it has the element's number, tag, class, id and the element's place among the elements of its parent (those of its tag: nth of
    n_same; all: place of n_all). Numbers are those of nodes(). A null page has no elements.
    """
    link = pa.struct([("node", pa.int32()), ("tag", pa.string()), ("cls", pa.string()), ("id", pa.string()), ("nth", pa.int32()), ("n_same", pa.int32()), ("place", pa.int32()), ("n_all", pa.int32())])
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.list_(link))
    names = ["page_id", "node_id", "subtree_end", "attrs", "own_text", "chain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for page, tree in _trees(batch):
                links, counts, said = {}, {}, {}
                for i, (parent, _, _, tag, attrs, data, _, _) in enumerate(tree.rows):
                    if tag is None:
                        said.setdefault(parent, []).append(data)
                        continue
                    same, every = counts.setdefault((parent, tag), []), counts.setdefault(parent, [])
                    links[i] = {"node": i, "tag": tag, "cls": attrs.get("class", ""), "id": attrs.get("id"), "nth": len(same) + 1, "place": len(every) + 1}
                    same.append(i)
                    every.append(i)
                for i, one in links.items():
                    parent = tree.rows[i][0]
                    one["n_same"], one["n_all"] = len(counts[parent, one["tag"]]), len(counts[parent])
                for i, one in links.items():
                    row = tree.rows[i]
                    for column, x in zip(out, (page, i, row[6], list(row[4].items()), "".join(said.get(i, [])), [*(links[a] for a in row[7]), one]), strict=True):
                        column.append(x)
                if len(out[0]) >= MOST_ROWS:
                    yield _sent(out, kinds, names)
            if out[0]:
                yield _sent(out, kinds, names)

    small_batches(pages.sparkSession)
    return pages.select(F.col(key).cast("long"), html).mapInArrow(run, CHAINS)


def node_table(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """nodes() as a table written once, for selections that look at it more than once: each page is parsed once."""
    return written(nodes(spread(pages.select(key, html)), key, html))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    """Text of bytes: by a byte order mark, else strict UTF-8, else GBK."""
    rows = []
    for b in content:
        if b is None:
            rows.append((None, None))
            continue
        for mark, name, codec in ((b"\xef\xbb\xbf", "utf-8-bom", "utf-8"), (b"\xff\xfe", "utf-16le", "utf-16-le"), (b"\xfe\xff", "utf-16be", "utf-16-be")):
            if b.startswith(mark):
                rows.append((b[len(mark) :].decode(codec, "replace"), name))
                break
        else:
            try:
                rows.append((b.decode(), "utf-8"))
            except UnicodeDecodeError:
                rows.append((b.decode("gbk", "replace"), "gbk"))
    return pd.DataFrame(rows, columns=["text", "encoding"])


def container(name: Column, content: Column) -> Column:
    """What a file holds, by its first bytes and name: epub, text, or rejected."""
    zipped = F.substring(content, 1, 4) == F.lit(b"PK\x03\x04")
    named = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(zipped, "epub").when(named.isin("epub", "pdf", "mobi", "azw3", "umd"), "rejected").otherwise("text")


def json_object(x: Column) -> Column:
    """An object of JSON as a variant, also with single quotes around names and values; null for anything else."""
    strict = F.try_parse_json(x)
    lenient = F.from_json(x, "variant", {"allowSingleQuotes": "true"})
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    return F.when(is_object(strict), strict).when(strict.isNull() & is_object(lenient), lenient)


def import_sources(files: DataFrame) -> DataFrame:
    """path, ord, raw (variant) of each source in whole-text files (path, value) of an object or an array; error for a file that is neither.

    A bad file is a row of its own and doesn't stop the others.
    """
    v = F.try_parse_json("value")
    rows = files.select("path", v.alias("v"))
    kind = F.schema_of_variant("v")
    one = rows.filter(F.startswith(kind, F.lit("OBJECT"))).select("path", F.lit(0).alias("ord"), F.col("v").alias("raw"), F.lit(None).cast("string").alias("error"))
    arrays = rows.filter(F.startswith(kind, F.lit("ARRAY")))
    many = arrays.lateralJoin(files.sparkSession.tvf.variant_explode(F.col("v").outer())).select("path", F.col("pos").alias("ord"), F.col("value").alias("raw"), F.lit(None).cast("string").alias("error"))
    bad = rows.filter(F.col("v").isNull() | ~kind.rlike("^(OBJECT|ARRAY)")).select("path", F.lit(0).alias("ord"), F.lit(None).cast("variant").alias("raw"), F.lit("not an object or array").alias("error"))
    return one.union(many).union(bad)
