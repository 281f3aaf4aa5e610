"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word of length l is indexed by its two halves: after one edit at least one of them is left as it was. Words of the same
length probe with their halves in the same places, words one longer with the substrings where the halves of the shorter word stand
if one of their code points is left out (the second half is moved by one). Equal keys give candidates, which are verified.

A half may be common to very many words. The other half then is a window in which the edit lies, and it is cut in
two in the same way: whichever part the edit isn't in is left as it was, and joins the key. Keys of more than GROUP indexed
words are refined like that, level by level, until the window is one code point wide. Words with one such key
differ in that code point alone, so there are at most as many as letters: no key is ever hot, and nothing is left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, spread, spread_join, text_bytes, written

RUNS = re.compile("[a-zÀ-ÿ]+")
SLIP, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Indexed words of a key, beyond which it is refined.
GROUP = 64
#: Words (and their code points) that a task sums up before it passes them on.
KEEP, KEEP_CHARS = 200_000, 8 << 20
#: Keys (of 8 bytes) that are broadcast.
BROADCAST_KEYS = 1_000_000
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def words_of(doc_id: int | None, data: bytes, slip: int = SLIP, least: int = LEAST_LENGTH) -> dict[str, int]:
    """How often each word of at least `least` code points stands in a text.

    A run loses a code point if slip divides h, the CRC-32 of `<doc_id>:<run>` (a null doc_id is written as nothing).
    """
    runs: dict[str, int] = {}
    for run in RUNS.findall(data.translate(_LOWER).decode("utf-8", "replace")):
        if len(run) >= least:
            runs[run] = runs.get(run, 0) + 1
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    slips = [(run, h) for run in runs if (h := zlib.crc32(run.encode(), start)) % slip == 0]
    slipped = [(run, h, runs.pop(run)) for run, h in slips]
    for run, h, n in slipped:
        if len(run) > least:
            short = run[: h % len(run)] + run[h % len(run) + 1 :]
            runs[short] = runs.get(short, 0) + n
    return runs


def counted(docs: DataFrame, slip: int = SLIP, least: int = LEAST_LENGTH, keep: int = KEEP) -> DataFrame:
    """word, n: how often each word stands in all texts, summed up in the tasks first (about `keep` words at a time)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        chars = 0

        def taken() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                for word, n in words_of(doc_id, data, slip, least).items():
                    if word in held:
                        held[word] += n
                    else:
                        held[word] = n
                        chars += len(word)
                if len(held) >= keep or chars >= KEEP_CHARS:
                    yield taken()
                    held.clear()
                    chars = 0
        if held:
            yield taken()

    small_batches(docs.sparkSession)
    summed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return summed.groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(rows: DataFrame, *names: str | Column) -> DataFrame:
    """A key of the window's place and of what stands before and after it. rows: word, moved, l, a, b (in the word of length l)."""
    key = F.expr("xxhash64(l, a, b, substring(word, 1, a), substring(word, b + moved + 1))")
    return rows.select(*names, "word", "n", "moved", "l", "a", "b", key.alias("key"))


def _refined(rows: DataFrame) -> DataFrame:
    """Both halves of the window, each with a key of its own."""
    cut = F.explode(F.expr("array(named_struct('a', a, 'b', (a + b) div 2), named_struct('a', (a + b) div 2, 'b', b))"))
    return _keyed(rows.select("word", "n", "moved", "l", cut.alias("w")).select("word", "n", "moved", "l", F.col("w.a").cast("int").alias("a"), F.col("w.b").cast("int").alias("b")))


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """one, n_one, other, n_other: all pairs of words (word, n: a written table, each word once) that one edit makes equal, each pair once.

    Words have at least two code points.
    """
    length = F.length("word")
    windows = F.explode(F.expr("array(named_struct('a', l div 2, 'b', l), named_struct('a', 0, 'b', l div 2))"))

    def cut(moved: int) -> DataFrame:
        """The windows of words as those of length l (moved 0) or with one code point more."""
        rows = words.select("word", "n", F.lit(moved).alias("moved"), (length - moved).alias("l")).select("*", windows.alias("w"))
        return written(_keyed(rows.select("word", "n", "moved", "l", F.col("w.a").cast("int").alias("a"), F.col("w.b").cast("int").alias("b"))))

    indexed, longer, found = cut(0), cut(1), []
    while True:
        many = (F.col("n_words") > group) & (F.col("width") > 1)
        hot = written(indexed.groupBy("key").agg(F.count("*").alias("n_words"), F.max(F.col("b") - F.col("a")).alias("width")).filter(many).select("key"))
        done = hot.isEmpty()
        if not done:
            rest = [written(_refined(_with(x, hot, "left_semi"))) for x in (indexed, longer)]
            indexed, longer = [_with(x, hot, "left_anti") for x in (indexed, longer)]
        asked = indexed.union(longer).select("key", "moved", F.col("word").alias("other"), F.col("n").alias("n_other"))
        met = indexed.select("key", F.col("word").alias("one"), F.col("n").alias("n_one")).join(asked, "key")
        found.append(written(met.filter("(moved = 1 OR one < other) AND levenshtein(one, other, 1) = 1").select("one", "n_one", "other", "n_other")))
        if done:
            return reduce(DataFrame.union, found).distinct()
        indexed, longer = rest


def _with(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows with (left_semi) or without (left_anti) one of the keys, of 8 bytes each: broadcast up to a million."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, "key", how)


def forms(words: DataFrame, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root of each of the words (word, n: a written table, each word once).

    A word's form is its near word of the largest n (of equal ones the first in code-point order) if that is at least
    ratio times its own n; n grows by that factor along forms, so that the root is reached within a few steps.
    """
    pairs = written(near_pairs(words, group))
    both = pairs.union(pairs.select("other", "n_other", "one", "n_one"))
    best = F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other").alias("form")))
    near = both.groupBy(F.col("one").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    has = F.col("n") * ratio <= -F.col("best.less")
    named = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    step = written(named.filter("form IS NOT NULL").select("word", "form"))
    reached, at, k = [], step, 1
    while not at.isEmpty():
        reached.append(at.select("word", F.lit(k).alias("k"), F.col("form").alias("root")))
        on = spread_join(at.select(F.col("word").alias("from"), F.col("form").alias("word")), step, ["word"], F.octet_length("word") + F.octet_length("form"))
        at, k = written(on.select(F.col("from").alias("word"), "form")), k + 1
    if not reached:
        return named.withColumn("root", F.col("word"))
    roots = reduce(DataFrame.union, reached).groupBy("word").agg(F.max_by("root", "k").alias("root"))
    return named.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, slip: int = SLIP, least: int = LEAST_LENGTH, least_n: int = LEAST_COUNT, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words of docs (doc_id, text) with at least `least` code points and least_n occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z only. Null and empty texts have none; texts
    of any length are read whole; repeated rows count again; a null doc_id slips as an empty one. Other columns are left
    out. Empty docs: empty result.
    """
    words = written(counted(docs, slip, least).filter(F.col("n") >= least_n))
    return forms(words, ratio, group)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_spelling_variants: the words of all documents."""
    return variants(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))).select("word", "form", "root", "n", "n_near", "form_n")


#: CRC-32 bit by bit over the UTF-8 bytes; DuckDB's levenshtein counts bytes, so U+00C0 to U+00FF are mapped to one byte each.
SQL = """
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
b AS (
  SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [195::BIGINT, ord(ch)::BIGINT - 64] END)) AS bytes FROM c),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda crc, y: list_reduce(list_prepend(xor(crc, y), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM b),
s AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n, array_to_string(list_transform(string_split(word, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN ch ELSE chr(ord(ch) - 159) END), '') AS narrow
  FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
k AS (SELECT *, length(word) AS l, length(word) AS own, left(narrow, length(word) // 2) AS one, substr(narrow, length(word) // 2 + 1) AS two FROM w
  UNION ALL SELECT *, length(word) - 1, length(word), left(narrow, (length(word) - 1) // 2), substr(narrow, (length(word) - 1) // 2 + 2) FROM w),
m AS (
  SELECT x.word AS a, y.word AS z FROM k x JOIN k y ON x.l = y.l AND x.one = y.one WHERE x.own = x.l AND levenshtein(x.narrow, y.narrow) = 1
  UNION SELECT x.word, y.word FROM k x JOIN k y ON x.l = y.l AND x.two = y.two WHERE x.own = x.l AND levenshtein(x.narrow, y.narrow) = 1),
p AS (SELECT a, z FROM m UNION SELECT z, a FROM m),
q AS (SELECT a, count(*) AS n_near, max(n) AS best FROM p JOIN w ON w.word = z GROUP BY a),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 5 * w.n THEN best END AS form_n,
    CASE WHEN best >= 5 * w.n THEN (SELECT min(z COLLATE "binary") FROM p JOIN w v ON v.word = z WHERE p.a = w.word AND v.n = best) END AS form
  FROM w LEFT JOIN q ON q.a = w.word),
g AS (SELECT word, word AS root FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT word, form, g.root, n, n_near, form_n FROM f JOIN g USING (word) WHERE g.root IN (SELECT word FROM f WHERE form IS NULL)
"""
