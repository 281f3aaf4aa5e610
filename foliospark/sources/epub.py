"""EPUB files as rows: one for each document of the reading order, and one for each navigation entry."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Budgets of an archive.
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_BYTES = 10_000, 32 << 20, 512 << 20
COLUMNS = "path string, kind string, ord int, depth int, href string, title string, content string, error string"


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _find(root: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in root.iter() if _name(e.tag) == name)


def _rows(content: bytes) -> Iterator[tuple]:
    """kind, ord, depth, href, title, content of a book's documents and navigation entries."""
    book = zipfile.ZipFile(io.BytesIO(content))
    infos = book.infolist()
    if len(infos) > MAX_ENTRIES or any(i.file_size > MAX_ENTRY_BYTES for i in infos) or sum(i.file_size for i in infos) > MAX_BYTES:
        raise ValueError("the archive is over its budget")
    names = {i.filename for i in infos}

    def parse(name: str) -> ElementTree.Element:
        data = book.read(name)
        if b"<!ENTITY" in data:
            raise ValueError(f"{name} declares entities")
        return ElementTree.fromstring(data)

    opf = next(_find(parse("META-INF/container.xml"), "rootfile")).attrib["full-path"]
    package, base = parse(opf), posixpath.dirname(opf)
    full = lambda href, at=base: posixpath.normpath(posixpath.join(at, unquote(href)))
    items = {i.attrib["id"]: i.attrib for i in _find(package, "item")}
    n = 0
    for ref in _find(package, "itemref"):
        item = items.get(ref.attrib.get("idref", ""))
        if item and (name := full(item["href"])) in names:
            yield "document", n, 0, name, None, book.read(name).decode("utf-8", "replace")
            n += 1
    ncx = next((i for i in items.values() if i.get("media-type") == "application/x-dtbncx+xml"), None)
    nav = next((i for i in items.values() if "nav" in i.get("properties", "").split()), None)
    order = 0

    def entries(element: ElementTree.Element, depth: int, at: str, point: str, link: str, attribute: str) -> Iterator[tuple]:
        nonlocal order
        for e in element:
            inner = depth
            if _name(e.tag) == point:
                target = next((x for x in e if _name(x.tag) == link), None)
                label = target if link == "a" else next((x for x in e if _name(x.tag) == "navLabel"), None)
                if target is not None:
                    path, mark, fragment = target.attrib.get(attribute, "").partition("#")
                    title = " ".join("".join(label.itertext()).split()) if label is not None else ""
                    yield "navigation", order, depth, full(path, at) + mark + fragment, title, None
                    order += 1
                inner += 1
            yield from entries(e, inner, at, point, link, attribute)

    if nav is not None:
        name = full(nav["href"])
        toc = next((e for e in _find(parse(name), "nav") if any(_name(k) == "type" and "toc" in v.split() for k, v in e.attrib.items())), None)
        if toc is not None:
            yield from entries(toc, 0, posixpath.dirname(name), "li", "a", "href")
            return
    if ncx is not None:
        name = full(ncx["href"])
        yield from entries(next(_find(parse(name), "navMap")), 0, posixpath.dirname(name), "navPoint", "content", "src")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all .epub files below a path. A file that can't be read is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4)
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [(where, *r, None) for r in _rows(content.as_py())]
                except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows = [(where, "error", 0, 0, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")
    return files.mapInArrow(run, COLUMNS)
