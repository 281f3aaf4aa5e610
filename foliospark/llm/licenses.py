"""License scans by diagonal voting.

All rolling grams of GRAM words of all texts are joined by Spark to the places of the same grams in license templates. A hit at
word p of a document and word t of a template votes for the diagonal p - t, the place where the whole template would
begin. Votes are summed by diagonal; neighbouring diagonals of a template (words left out or put in move it by a few)
are merged, and those with enough votes are verified: the template's words are aligned with the words there,
and the span counts if it holds at least SHARE of them. Of overlapping spans the one with the largest share stays, so
that versions of a license that differ in a word don't both count.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, BROADCAST_ROWS, map_batches, small_batches, spread, text_bytes, written
from .words import gram_hashes, word_hashes

#: Share of a template's words that a span holds at least; share of its grams that vote; diagonals apart that are merged.
GRAM, SHARE, VOTES, SLACK = 3, 0.8, 0.3, 3
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Bytes between words, of lower-cased texts: ASCII but digits and letters.
_GAPS = np.array([x < 0x80 and not (0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A) for x in range(256)])
_WORDS = bytes(32 if _GAPS[x] else x for x in range(256))

#: Phrases that name a license wherever their words stand in a row.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Template(NamedTuple):
    label: str
    text: str


#: Notices of common licenses (fixed values: the licenses' own public texts).
TEMPLATES = (
    Template("mit", "released under the MIT License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("apache-2", "licensed under the Apache License, Version 2.0"),
    Template("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("gpl-2", "licensed under the GNU General Public License, version 2"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3"),
    Template("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    Template("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("lgpl-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    Template("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    Template("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc0", "To the extent possible under law, the person has waived all copyright and related or neighboring rights to this work"),
    Template("cc-by", "licensed under CC BY 4.0"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0"),
    Template("cc-by-nc-nd", "licensed under CC BY-NC-ND 4.0"),
    Template("cc-by-nd", "licensed under CC BY-ND 4.0"),
)


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: lower-cased (A-Z alone), anything but ASCII signs."""
    return text.translate(_LOWER).translate(_WORDS).split()


def grams_of(text: bytes, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each `gram` consecutive words."""
    return gram_hashes(word_hashes(text.translate(_LOWER), gaps=_GAPS)[0], gram)


class Span(NamedTuple):
    """Words [start, end) of a document that hold the share of a template's words."""

    template: int
    start: int
    end: int
    share: float


def verified(words: list[bytes], template: list[bytes], number: int, low: int, high: int, share: float = SHARE, slack: int = SLACK) -> Span | None:
    """The span of the template that begins at about one of the words low to high, if it holds enough of its words."""
    first = max(0, low - slack)
    there = words[first : high + len(template) + slack]
    blocks = [b for b in SequenceMatcher(None, template, there, autojunk=False).get_matching_blocks() if b.size]
    held = sum(b.size for b in blocks) / len(template)
    return Span(number, first + blocks[0].b, first + blocks[-1].b + blocks[-1].size, held) if held >= share else None


def apart(spans: Iterable[Span], sizes: list[int]) -> list[Span]:
    """Of overlapping spans those with the largest share (then of the longest template, then the first)."""
    out: list[Span] = []  # by start; no two overlap
    for s in sorted(set(spans), key=lambda s: (-s.share, -sizes[s.template], s.template, s.start)):
        k = bisect_left(out, s.start, key=lambda o: o.start)
        if (k == 0 or out[k - 1].end <= s.start) and (k == len(out) or s.end <= out[k].start):
            out.insert(k, s)
    return out


def places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """Where a phrase's words stand in a row, by place, with its label."""
    line, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        sought = f" {phrase} ".encode()
        at, passed, behind = line.find(sought), 0, 0
        while at >= 0:
            passed += line.count(b" ", behind, at)
            behind = at
            out.append((passed, label))
            at = line.find(sought, at + 1)
    return sorted(out)


def votes(docs: DataFrame, row: list[str], templates: tuple[Template, ...] = TEMPLATES, gram: int = GRAM, share: float = VOTES, slack: int = SLACK) -> DataFrame:
    """row's columns, candidates (template, low, high: its diagonals): for each row with enough votes for some template."""
    spark = docs.sparkSession

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams = pa.array([grams_of(t, gram).view(np.int64) for t in text_bytes(batch.column(len(row)))], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(row)], grams], [*row, "grams"])

    grams = [(int(h), k, t) for k, x in enumerate(templates) for t, h in enumerate(grams_of(x.text.encode(), gram).view(np.int64))]
    sizes = [len(words_of(x.text.encode())) for x in templates]
    places = spark.createDataFrame(grams, "h long, template int, t int")
    of = F.element_at(F.lit(sizes), F.col("template") + 1)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in row)
    all_grams = map_batches(docs.select(*row, "text"), make, f"{fields}, grams array<bigint>").select(*row, F.posexplode("grams").alias("p", "h"))
    hits = all_grams.join(F.broadcast(places) if len(grams) <= BROADCAST_ROWS else places, "h")
    diagonals = hits.groupBy(*row, "template", (F.col("p") - F.col("t")).alias("d")).agg(F.count("*").alias("n"))
    # neighbouring diagonals, in stretches no longer than the template
    by = Window.partitionBy(*row, "template").orderBy("d")
    begins = F.col("d") - F.lag("d").over(by) <= slack
    runs = diagonals.withColumn("run", F.sum(F.when(begins, 0).otherwise(1)).over(by))
    stretch = F.floor((F.col("d") - F.min("d").over(Window.partitionBy(*row, "template", "run"))) / of)
    merged = runs.withColumn("stretch", stretch).groupBy(*row, "template", "run", "stretch").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.sum("n").alias("n"))
    enough = merged.filter(F.col("n") >= F.greatest(F.lit(1.0), share * (of - gram + 1)))
    return enough.groupBy(*row).agg(F.collect_list(F.struct("template", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"))).alias("candidates"))


def scan(docs: DataFrame, row: list[str] | None = None, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, gram: int = GRAM, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of each row of docs (doc_id, text).

    n_base, first_word and last_word are of the phrases' places; spans (label, start, end, share) of the templates'. score is
    1 where a phrase stands, else the largest share of a span, else 0. row: columns that name a row, the same whenever docs is
    read (a file and a place in it); docs is then read twice. Without them docs is written with numbers first.

    Null and empty texts have no words and no labels (empty strings). Texts of any length are read whole. Repeated rows, and null
    and repeated ids, are rows like others. Other columns are left out. Empty docs: empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if row is None:
        row = ["__row"]
        docs = written(docs.select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id()))
    docs = docs.select("doc_id", "text", *row)
    found = written(votes(docs, row, templates, gram))
    n, size = found.agg(F.count("*"), F.sum(F.size("candidates") * 12 + 64)).first()
    few = n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
    asked = docs.join(F.broadcast(found) if few else found, row, "left").select("doc_id", "text", "candidates")
    sought = [words_of(t.text.encode()) for t in templates]
    sizes = [len(x) for x in sought]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, candidates in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = words_of(text)
            base = places(words, phrases)
            met = [verified(words, sought[c["template"]], c["template"], c["low"], c["high"], share) for c in candidates or []]
            spans = apart([s for s in met if s], sizes)
            own = {label for _, label in base}
            labels = own | {templates[s.template].label for s in spans}
            score = 1.0 if base else max((s.share for s in spans), default=0.0)
            first, last = (base[0][0], base[-1][0]) if base else (None, None)
            out.append((len(words), len(base), first, last, ",".join(sorted(own)), ",".join(sorted(labels)), score, [{"label": templates[s.template].label, "start": s.start, "end": s.end, "share": s.share} for s in spans]))
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
        columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(asked, make, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: bigint, end: bigint, share: double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_license_scan: the labels of every document. A row is named by its file and place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    out = scan(spread(docs), ["file", "place"])
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"))
