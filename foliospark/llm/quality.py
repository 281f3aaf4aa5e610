"""Quality rules, with host verdicts.

Each document is measured and judged by its own rules: base rules, and soft rules that good documents may break
now and then. The documents that fail any are then summed up by host; a host's failure rate is shrunk towards
that of all documents by a beta prior whose mean and strength are fitted to the hosts' rates by moments, each
host weighted by its documents and the noise of counting taken off, so that a host of few documents is judged
mildly. The verdict on the host is joined back to its documents: where the shrunk rate is within the prior's
usual range, one soft failure is forgiven; above that (strict) none is; and of a host most of whose documents
fail (blocked) none is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join, map_batches, small_batches, spread, text_bytes, written
from .words import gram_hashes, word_hashes

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_SYMBOL_PERCENT, MAX_DUP_LINES_PERCENT = 50, 50, 10, 50
#: A host is strict if its shrunk rate is over the prior's mean by this many of the prior's standard deviations,
#: and blocked if it is over this rate.
STRICT_SD, BLOCK_RATE = 0.25, 0.5
#: Soft failures that are forgiven where the host is not strict.
FORGIVEN = 1
#: The prior is worth this many documents at most (where hosts don't differ by more than chance).
MAX_STRENGTH = 1000.0
_SYMBOLS = b"#*$%&|<>"
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measures(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    chars = len(b"".join(words).decode())
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = 0
    if len(words) > 3:
        grams = gram_hashes(word_hashes(text)[0], 3)
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
        same = np.zeros(len(grams) + 1, bool)
        same[1:-1] = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(words), bool)
        at = order[same[1:] | same[:-1]]
        for k in range(3):
            twice[at + k] = True
        repeats = int(twice.sum())
    return len(words), chars, symbols, lines, dup, repeats


def measured(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with the measures (long) and the rules' results; without their text, unless it is to be kept."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in (text, *_FIELDS)]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([measures(t) for t in text_bytes(batch.column(len(names)))], np.int64).reshape(-1, len(_FIELDS))
        columns = batch.columns if keep_text else batch.columns[:-1]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(rows[:, k]) for k in range(len(_FIELDS))]], [*names, *[text] * keep_text, *_FIELDS])

    kept = docs.select(*[f"`{c}`" for c in (*names, text)])
    fields = kept.schema.fields if keep_text else kept.schema.fields[:-1]
    out = map_batches(kept, make, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{n} long" for n in _FIELDS)]))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    soft = [100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"), 100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * F.col("n_lines")]
    return out.withColumn("base_failed", base).withColumn("soft_failures", soft[0].cast("int") + soft[1].cast("int")).withColumn("failed", F.col("base_failed") | (F.col("soft_failures") > 0))


def fit_prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and strength of the beta prior, from one row of sums over hosts (docs, failures).

    The variance of the hosts' true rates is that of their observed ones about the mean, each host weighted by its
    documents, less what counting alone gives (mean (1 - mean) for each host but one), over 1 - sum(docs^2) / sum(docs)^2.
    """
    docs, failures, squares, hosts_, spread = hosts.agg(F.sum("docs"), F.sum("failures"), F.sum(F.col("docs").cast("double") * F.col("docs")), F.count("*"), F.sum(F.col("failures").cast("double") * F.col("failures") / F.col("docs"))).first()
    if not docs:
        return 0.0, MAX_STRENGTH
    m = failures / docs
    between = 1 - squares / (float(docs) * docs)
    v = (spread / docs - m * m - (hosts_ - 1) * m * (1 - m) / docs) / between if between > 0 else 0.0
    return m, min(MAX_STRENGTH, max(1.0, m * (1 - m) / v - 1)) if v > 0 else MAX_STRENGTH


def host_verdicts(judged: DataFrame, host: str = "host", strict_sd: float = STRICT_SD, block_rate: float = BLOCK_RATE) -> DataFrame:
    """host, docs, failures, rate (shrunk), strict, blocked: a written table with a row for each host."""
    hosts = written(judged.groupBy(host).agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures")))
    m, s = fit_prior(hosts)
    bound = m + strict_sd * (m * (1 - m) / (s + 1)) ** 0.5
    shrunk = (F.col("failures") + F.lit(m * s)) / (F.col("docs") + F.lit(s))
    return written(hosts.withColumn("rate", shrunk).withColumn("strict", F.col("rate") > bound).withColumn("blocked", F.col("rate") > block_rate))


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs (without their text, unless keep_text) with the measures, base_failed, soft_failures, failed, strict, blocked, kept.

    A document is kept if it fails no base rule, its host isn't blocked, and it has no soft failure, or one where
    the host isn't strict. Every row is judged for itself: rows with equal or null ids, and repeated rows, count as
    often as they stand. Null and empty texts have no words and fail; texts of any length are read whole. A null
    host is a host of its own. Columns of docs with the result's names are replaced. Empty docs: empty result.
    """
    new = {"base_failed", "soft_failures", "failed", "strict", "blocked", "kept", "__host"}
    rows = docs.select(*[f"`{c}`" for c in docs.columns if c not in new], F.when(F.col(host).isNull(), "").otherwise(F.concat(F.lit("h"), F.col(host).cast("string"))).alias("__host"))
    judged = written(measured(rows, text, keep_text))
    verdicts = host_verdicts(judged, "__host").select("__host", "strict", "blocked")
    out = lookup_join(judged, verdicts, "__host").drop("__host")
    allowed = F.when(F.col("strict"), 0).otherwise(FORGIVEN)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("blocked") & (F.col("soft_failures") <= allowed))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_quality_rules over all documents; strict is the verdict on the document's host."""
    out = judge(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "soft_failures", "strict")


SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 'h' || source END AS host, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w,
  length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS n_symbols,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, len(lines) AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  (100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words)::INT + (100 * n_dup_lines > {MAX_DUP_LINES_PERCENT} * n_lines)::INT AS soft_failures FROM m),
h AS (SELECT host, count(*)::DOUBLE AS docs, count_if(base_failed OR soft_failures > 0)::DOUBLE AS failures FROM f GROUP BY host),
sums AS (SELECT sum(failures) / sum(docs) AS m, 1 - sum(docs * docs) / (sum(docs) * sum(docs)) AS between_, sum(failures * failures / docs) / sum(docs) AS spread, count(*) AS hosts, sum(docs) AS docs FROM h),
var AS (SELECT m, CASE WHEN between_ > 0 THEN (spread - m * m - (hosts - 1) * m * (1 - m) / docs) / between_ ELSE 0 END AS v FROM sums),
prior AS (SELECT m, CASE WHEN v > 0 THEN least({MAX_STRENGTH}, greatest(1.0, m * (1 - m) / v - 1)) ELSE {MAX_STRENGTH} END::DOUBLE AS s FROM var),
verdict AS (SELECT host, (failures + m * s) / (docs + s) > m + {STRICT_SD} * sqrt(m * (1 - m) / (s + 1)) AS strict, (failures + m * s) / (docs + s) > {BLOCK_RATE} AS blocked FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT blocked AND soft_failures <= CASE WHEN strict THEN 0 ELSE {FORGIVEN} END AS kept, soft_failures, strict
FROM f JOIN verdict USING (host)
"""
