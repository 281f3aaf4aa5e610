"""Substring dedup by a log-structured fingerprint index.

A window is WIDTH consecutive words of one document. Every window names one of its GRAM-word grams,
that with the least hash (the leftmost of equal ones), as its anchor: equal windows have equal anchors,
and neighbouring windows mostly share theirs, so that an index of anchors has a row for about seven words.

The index is a list of immutable runs, each a table in the shared folder, bucketed and sorted by h, with one row for each
anchor: its first document and whether another has it too. A new batch's anchors are summed up to such a run, which is
merge-joined, bucket by bucket and without a shuffle, with each earlier run. What meets, or stands twice in the batch,
is shared: it goes back to the batch's documents, and to the one document that had an anchor alone so far (those that had
it before with others know already). Anchors of very many documents are not shuffled on that way. Once there are more
than max_runs runs they are compacted into one.

A verification pass then looks at all windows of the shared anchors in the documents that have them: windows count as
equal if a second, independent 64-bit hash of all their words and 32 bits of their anchor's hash agree. An aggregation keeps
the smallest doc_id and start of each window; all later ones are repeats.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import remove, scratch
from . import common
from .common import map_batches, partitions, range_buckets, shared_dir, small_batches, spread_join, text_bytes, written
from .words import gram_hashes, word_hashes

WIDTH, GRAM = 20, 8
#: Rows without a doc_id are documents with numbers below this one, before all others.
LEAST_ID = -(2**62)


def anchors(words: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams, and for each window the place of its anchor among them."""
    grams = gram_hashes(words, gram)
    if len(words) < width:
        return grams, np.zeros(0, np.int64)
    n = width - gram + 1
    return grams, sliding_window_view(grams, n).argmin(axis=1) + np.arange(len(grams) - n + 1)


def _anchor_rows(width: int, gram: int):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, ids, twice = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            grams, at = anchors(word_hashes(text)[0], width, gram)
            if len(at):
                own, times = np.unique(grams[at[np.flatnonzero(np.diff(at, prepend=-1))]], return_counts=True)
                found.append(own)
                ids.append(np.full(len(own), i, np.int64))
                twice.append(times > 1)  # shared within the document
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(twice))], ["h", "doc_id", "twice"])

    return make


def _candidates(text: bytes, hits: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, window hashes and anchor hashes of the windows whose anchor is among the hits."""
    one, two = word_hashes(text, 2)
    grams, at = anchors(one, width, gram)
    if not len(at):
        return at, grams[:0], grams[:0]
    own = grams[at]
    starts = np.flatnonzero(np.isin(own, hits.view(np.uint64)))
    return starts, gram_hashes(two, width)[starts], own[starts]


def _window_rows(width: int, gram: int, numbered: bool):
    """The first start in the row of each candidate window, with the row's number if they are numbered."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = [[], [], [], [], []]
        hits, nums = batch.column(2), batch.column(3).to_pylist()
        for j, (i, text) in enumerate(zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True)):
            starts, w, h = _candidates(text, hits[j].values.to_numpy(), width, gram)
            if len(starts):
                w, first = np.unique(w, return_index=True)
                for part, x in zip(out, (w.view(np.int64), (h[first] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(len(w), i, np.int64), starts[first].astype(np.int32), np.full(len(w), nums[j], np.int64)), strict=True):
                    part.append(x)
        if not out[0]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out[: 4 + numbered]], ["w", "h", "doc_id", "start", "num"][: 4 + numbered])

    return make


def _cut_rows(width: int, gram: int):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, hits, firsts, nums = batch.column(0), batch.column(2), batch.column(3), batch.column(4).to_pylist()
        n_words, n_removed, kept, gone = [], [], [], []
        for j, text in enumerate(text_bytes(batch.column(1))):
            words, cuts = text.split(), []
            if hits[j].is_valid:
                starts, _, _ = _candidates(text, hits[j].values.to_numpy(), width, gram)
                if firsts[j].is_valid:
                    own = firsts[j].values
                    starts = starts[~np.isin(starts, own.field("start").to_numpy()[own.field("num").to_numpy() == nums[j]])]
                if len(starts):
                    depth = np.zeros(len(words) + 1, np.int64)
                    depth[starts] += 1
                    np.subtract.at(depth, starts + width, 1)
                    cut = np.cumsum(depth[:-1]) > 0
                    edges = np.flatnonzero(np.diff(cut, prepend=False, append=False))
                    cuts = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            total = len(words)
            for c in reversed(cuts):
                del words[c["start"] : c["end"]]
            n_words.append(total)
            n_removed.append(total - len(words))
            kept.append(b" ".join(words))
            gone.append(cuts)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(gone, span)], ["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    return make


_RUN = "h BIGINT, doc_id BIGINT, shared BOOLEAN, n BIGINT"


class FingerprintIndex:
    """Runs of anchor hashes below one folder of the shared store, and the files of each batch's hits. log has the number of runs after each step."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, max_runs: int = 4, width: int = WIDTH, gram: int = GRAM):
        self.spark, self.root = spark, shared_dir(spark)
        self.buckets, self.max_runs, self.width, self.gram = buckets or partitions(spark), max_runs, width, gram
        self.runs: list[str] = []
        self.hits: list[str] = []
        self.log: list[tuple[str, int]] = []
        small_batches(spark)

    @classmethod
    def reopen(cls, spark: SparkSession, root: str, runs: list[str], hits: list[str], buckets: int, **options) -> FingerprintIndex:
        """The index below root (its root, runs, hits and buckets as they were), in another session."""
        index = cls(spark, buckets, **options)
        index.root, index.runs, index.hits = root, list(runs), list(hits)
        for name in runs:
            if not spark.catalog.tableExists(name):
                spark.sql(f"CREATE TABLE {name} ({_RUN}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {buckets} BUCKETS LOCATION '{root}/{name}'")
        return index

    def _write(self, rows: DataFrame) -> str:
        """A run of rows (h, doc_id, shared, n), those of one anchor as one; n is the number of documents. The sum's exchange is the buckets', so that each is one sorted file."""
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        run = rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), (F.bool_or("shared") | (F.sum("n") > 1)).alias("shared"), F.sum("n").alias("n"))
        if self.buckets != partitions(self.spark):
            run = run.repartition(self.buckets, "h")
        run.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _met(self, rows: DataFrame, met: DataFrame, run: DataFrame) -> DataFrame:
        """rows whose h is in met. Anchors of very many documents, which the run names, are not shuffled on the way."""
        if met.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
            return rows.join(F.broadcast(met), "h", "left_semi")
        most = max(common.HOT_ROWS, rows.count() // common.HOT_KEYS)
        hot = written(run.filter(F.col("n") > most).select("h"))  # fewer than HOT_KEYS, all of them met
        rest = rows.join(F.broadcast(hot), "h", "left_anti").join(met, "h", "left_semi")
        return rows.join(F.broadcast(hot), "h", "left_semi").union(rest)

    def add(self, docs: DataFrame, recall: bool = True) -> DataFrame:
        """Adds (doc_id, text) as a new run. Returns (doc_id, h): the new documents' shared anchors, and the earlier documents' with these.

        Without recall, of the earlier documents only those that had one of these anchors alone: all others were returned before.
        """
        with scratch(self.spark):
            rows = written(map_batches(docs.select("doc_id", "text"), _anchor_rows(self.width, self.gram), "h long, doc_id long, twice boolean"))
            name = self._write(rows.select("h", "doc_id", F.col("twice").alias("shared"), F.lit(1).cast("long").alias("n")))
            new = self.spark.table(name)
            shared, hits = [new.filter("shared").select("h")], []
            for old in map(self.spark.table, self.runs):
                shared.append(new.join(old.hint("merge"), "h", "left_semi").select("h"))
                hits.append(old.filter("NOT shared").join(new.hint("merge"), "h", "left_semi").select("doc_id", "h"))
            met = written(reduce(DataFrame.union, shared).distinct())
            hits.append(self._met(rows.select("doc_id", "h"), met, new).select("doc_id", "h"))
            path = f"{self.root}/hits_{uuid.uuid4().hex}"
            reduce(DataFrame.union, hits).write.parquet(path)
            found = self.spark.read.parquet(path)
            if recall and self.hits:
                found = written(found.union(spread_join(self.spark.read.parquet(*self.hits), met, ["h"]).select("doc_id", "h")), lasting=True)
        self.hits.append(path)
        self.runs.append(name)
        self.log.append(("add", len(self.runs)))
        if len(self.runs) > self.max_runs:
            self.compact()
        return found

    def compact(self) -> None:
        """All runs become one; their tables and files go once it is written. An anchor of two runs is shared, as both of its documents know."""
        # as plain files: a sum over a union of bucketed tables goes without an exchange, but also without the buckets
        name = self._write(self.spark.read.parquet(*[f"{self.root}/{run}" for run in self.runs]))
        self.drop(files=True)
        self.runs = [name]
        self.log.append(("compact", 1))

    def drop(self, files: bool = False) -> None:
        """Takes the runs out of the catalog, and their files from the shared folder if they aren't to be opened again."""
        for name in self.runs:
            self.spark.sql(f"DROP TABLE {name}")
            if files:
                remove(self.spark, f"{self.root}/{name}")
        self.runs = []

    def verify(self, docs: DataFrame, hits: DataFrame) -> DataFrame:
        """docs (doc_id, text, and num where rows have the same doc_id) without each word that a repeated window covers.

        Returns doc_id, n_words, n_removed, kept_text, removed (spans of words). docs must hold every
        document that hits names; num must be the same whenever docs is read. Both joins read one and the same exchange of the texts.
        """
        ties = "num" in docs.columns
        docs = docs.select("doc_id", "text", *["num"] * ties)
        num = F.col("num") if ties else F.lit(0).cast("long").alias("num")
        hits = written(hits.groupBy("doc_id").agg(F.collect_set("h").alias("hits")))
        candidates = docs.join(hits, "doc_id")
        windows = map_batches(candidates.select("doc_id", "text", "hits", num), _window_rows(self.width, self.gram, ties), "w long, h int, doc_id long, start int" + ", num long" * ties)
        if ties:
            firsts = windows.groupBy("w", "h").agg(F.min(F.struct("doc_id", "num", "start")).alias("f")).select("f.*")
        else:
            firsts = windows.groupBy("w", "h").agg(F.min("doc_id").alias("doc_id"), F.min_by("start", "doc_id").alias("start")).withColumn("num", F.lit(0).cast("long"))
        firsts = firsts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "num")).alias("firsts"))
        joined = docs.join(hits, "doc_id", "left").join(firsts, "doc_id", "left")
        return map_batches(joined.select("doc_id", "text", "hits", "firsts", num), _cut_rows(self.width, self.gram), "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start: bigint, end: bigint>>")


def dedup(docs: DataFrame, batches: int = 6, max_runs: int = 4, width: int = WIDTH, gram: int = GRAM, index: FingerprintIndex | None = None, number: str | None = None) -> DataFrame:
    """docs (doc_id, text) without repeated passages; batches of ascending doc_id go into a new index (or the one given).

    A word goes if a window over it has a word sequence that also starts earlier (smaller doc_id, or
    same document, earlier start). Null and empty texts have no words and an empty kept_text; texts of any length are read
    whole. Rows of equal doc_id are documents of their own, in the order of the column `number` (a long, the same whenever docs is read); without it, and if there are such rows or null
    ids, docs is written first. Rows without a doc_id come before all others, in an order of their own, and have none in the result.
    doc_ids are at least -2**62. Other columns of docs are left out. Empty docs: empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(number).alias("num")] if number else []))
    ties = not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if not number and ties:
        docs = written(docs.withColumn("num", F.monotonically_increasing_id()))
    # rows without an id get ids of their own, so that they aren't one hot key
    own_id = F.lit(-(2**63)) + F.pmod(F.xxhash64("num"), F.lit(2**62 - 1)) if "num" in docs.columns else F.lit(-(2**63))
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", own_id))
    if not ties:
        docs = docs.select("doc_id", "text")
    own = index or FingerprintIndex(spark, max_runs=max_runs, width=width, gram=gram)
    bounds, hits, below = range_buckets(docs, "doc_id", batches), [], None
    for bound in [*bounds, None]:
        batch = docs if below is None else docs.filter(F.col("doc_id") > below)
        batch = batch if bound is None else batch.filter(F.col("doc_id") <= bound)
        hits.append(own.add(batch, recall=False))
        below = bound
    out = own.verify(docs, reduce(DataFrame.union, hits))
    if index is None:  # the hits are gathered by now
        own.drop()
        remove(spark, own.root)
    return out.withColumn("doc_id", F.when(F.col("doc_id") >= LEAST_ID, F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_substring_dedup: the digest of every document. Six batches; the fifth run makes the index compact. Rows of one id go by file and place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "text", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("num"))
    out = dedup(docs, number="num")
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_spans"))
