"""Document fingerprints by consistent weighted sampling.

A document's terms are its words, weighted by how often they stand in it. For each of SAMPLES samples k and
each term, gamma variates r, c ~ Gamma(2, 1) and a uniform b come from the term's hash and k alone; with
t = floor(ln w / r + b), y = exp(r (t - b)) and a = c / (y exp(r)), the sample is the (term, t) with the
least a. Two documents share sample k with a chance equal to their generalised Jaccard similarity,
the sum of the smaller over the sum of the larger weights. A fingerprint has 16 bits of each sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, in_ranges, map_batches, small_batches, with_range
from .words import mix

SAMPLES = 64
#: Terms (with weight) whose variates a worker keeps, and their bytes; the store is emptied when it is full.
KEEP, KEEP_BYTES = 40_000, 16 << 20
_CHUNK = 8_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Sampler:
    """Variates of terms, kept in bounded arrays, and the signatures made of them."""

    def __init__(self, samples: int = SAMPLES, keep: int = KEEP):
        self.samples, self.keep, self.spent = samples, keep, 0
        self.rows: dict[tuple[bytes, int], int] = {}
        self.log_a = np.zeros((keep, samples), np.float32)
        self.codes = np.zeros((keep, samples), np.uint16)

    def _uniforms(self, hashes: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
        k = np.arange(self.samples, dtype=np.uint64) * np.uint64(3) + np.uint64(lane + 1)
        bits = mix(hashes[:, None] + k * _GOLD)
        scale = np.float32(2.0**-24)
        return ((bits >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * scale, ((bits & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * scale

    def _place(self, terms: list[tuple[bytes, int]]) -> np.ndarray:
        if len(self.rows) + len(terms) > self.keep or self.spent > KEEP_BYTES:
            self.rows.clear()
            self.spent = 0
        new = [t for t in terms if t not in self.rows]
        if new:
            self.spent += sum(len(t) for t, _ in new)
            hashes = np.fromiter((xxhash.xxh64_intdigest(t, 1) for t, _ in new), np.uint64, len(new))
            log_w = np.log(np.fromiter((w for _, w in new), np.float32, len(new)))[:, None]
            u1, u2 = self._uniforms(hashes, 0)
            r = -np.log(u1) - np.log(u2)
            u1, u2 = self._uniforms(hashes, 1)
            log_c = np.log(-np.log(u1) - np.log(u2))
            b, _ = self._uniforms(hashes, 2)
            t = np.floor(log_w / r + b)
            at = len(self.rows)
            self.log_a[at : at + len(new)] = log_c - r * (t - b) - r
            self.codes[at : at + len(new)] = (mix(hashes[:, None] ^ mix(t.astype(np.int64).view(np.uint64) + _GOLD)) >> np.uint64(48)).astype(np.uint16)
            for i, term in enumerate(new):
                self.rows[term] = at + i
        return np.fromiter((self.rows[t] for t in terms), np.int64, len(terms))

    def signature(self, text: str) -> np.ndarray:
        """The samples' codes; all 0 for a text without words."""
        terms = list(Counter(text.encode().split()).items())
        best, codes, each = None, np.zeros(self.samples, np.uint16), np.arange(self.samples)
        for i in range(0, len(terms), _CHUNK):
            rows = self._place(terms[i : i + _CHUNK])
            a = self.log_a[rows]
            least = a.argmin(axis=0)
            a, own = a[least, each], self.codes[rows[least], each]
            codes = own if best is None else np.where(a < best, own, codes)
            best = a if best is None else np.minimum(a, best)
        return codes


_SAMPLER: list[Sampler] = []


def _sampler(samples: int) -> Sampler:
    if not _SAMPLER or _SAMPLER[0].samples != samples:
        _SAMPLER[:] = [Sampler(samples)]
    return _SAMPLER[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _hex(codes: np.ndarray) -> str:
    return codes.astype(">u2").tobytes().hex()


def fingerprint(docs: DataFrame, text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """docs with a column fingerprint (one of that name is replaced, others stay): 4 hex digits for each sample.

    Null and empty texts: zeros; texts of any length are read whole. Repeated rows give equal results. Empty docs: empty result.
    """
    names = [c for c in docs.columns if c != "fingerprint"]
    small_batches(docs.sparkSession)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [_hex(_sampler(samples).signature(t or "")) for t in batch.column(names.index(text)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string())], [*names, "fingerprint"])

    docs = docs.select(*names)
    return map_batches(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", fingerprint string")


def edited_likeness(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """For each of docs (doc_id, text): its fingerprint, that of its text with the last third taken from the
    next document (descending doc_id, after the last the first), and the likeness of both and of the next one's.

    Documents are put into ranges of doc_id, each range into one partition, sorted; the last document of
    the range before comes with it (a copy for each range). So each text moves once and the fingerprint of
    a neighbour is at hand. Rows with equal doc_id are ordered by text; a null id comes after all in
    descending order; a null text is empty, one of any length is read whole. One document is its own neighbour. Other
    columns of docs are left out. Empty docs: empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged, ranges = with_range(docs, "doc_id")
    # at most 4 n rows: the largest id of each range
    ends = [(r["range"], r["m"]) for r in ranged.groupBy("range").agg(F.max("doc_id").alias("m")).orderBy("range").collect()]
    follows = [(m, ends[(i + 1) % len(ends)][0]) for i, (_, m) in enumerate(ends)]
    marks = spark.createDataFrame(follows, "doc_id long, follower int")
    copies = docs.join(F.broadcast(marks), "doc_id").select("doc_id", "text", F.col("follower").alias("range"), F.lit(0).alias("own"))
    rows = ranged.withColumn("own", F.lit(1)).select("doc_id", "text", "range", "own").union(copies)
    rows = in_ranges(rows, ranges, "own", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, before, codes_before = _sampler(samples), "", None
        for batch in batches:
            out = []
            for i, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                codes = sampler.signature(text)
                if own:
                    third = len(text) // 3
                    edited = text[: len(text) - third] + before[:third]
                    codes_edited = sampler.signature(edited)
                    out.append((i, len(text), edited, _hex(codes), _hex(codes_edited), likeness(codes, codes_edited), likeness(codes, codes_before)))
                before, codes_before = text, codes
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    out = rows.mapInArrow(run, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_document_fingerprints over all documents."""
    out = edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
