"""Quality rules, line dedup, near-duplicate removal, mixing and tokenisation of a corpus, one stage after another.

Every stage takes nulls in any column, empty texts and texts of any length, repeated rows and an empty table (which
stays empty). Columns beside those of documents are left out. Decisions are made row by row: a row's verdict is on
the row itself, or on a number of its own, so that null and repeated ids neither escape it nor spread it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import byte_bpe, line_dedup, mixing, near_texts, quality
from foliospark.llm.common import anti_join, spread, written
from foliospark.shared import remove, scratch, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The mixture's entropy lies this share of the way to the largest one, but no source is read more often than MAX_REPEATS times.
GAIN, MAX_REPEATS = 0.5, 2.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules don't keep go: each by its own failures and the verdict on its source.

    A null source is a source of its own; null and empty texts fail. The text is carried along, not joined back.
    """
    return quality.judge(docs.select(*COLUMNS), keep_text=True).filter("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a host go; copies of a text are one page there. n_chars is that of the text left.

    No row goes; a null text stays null (n_chars null), and a text all of whose lines go is empty.
    """
    out = line_dedup.dedup(docs.select(*COLUMNS), distinct=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (sets of five-word shingles with a similarity of 0.8 or more) one row stays, one with the smallest doc_id.

    Rows get a number when they are written with their fingerprints; it tells rows with equal or null ids apart. Rows with
    a null doc_id go if their group has one with a doc_id; of a group of such rows alone one stays. Null and empty
    texts are one group. The numbers of the rows that go are few, and joined back without moving texts where they
    fit a broadcast.
    """
    rows = near_texts.sketched(docs.select(*COLUMNS)).withColumn("__row", F.monotonically_increasing_id())
    rows = written(rows.withColumn("__key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")))
    return anti_join(rows, near_texts.near_rows(rows, "__key"), "__row").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source once in full at least; those of fewer words again, MAX_REPEATS times at most, in the mixture's order.

    The order is that of the rows: the files' names, and the rows in each. A source without a word in it (null and
    empty texts alone) goes. Rows of a source with equal or null ids are taken together.
    """
    return mixing.arranged(mixing.mix(docs.select(*COLUMNS), gain=GAIN, max_repeats=MAX_REPEATS)).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids of each row of the mixture, and its place: mix_file and mix_row (both ascend in its order).

    docs must be read from files. Null and empty texts have no ids.
    """
    file = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
    out = byte_bpe.encode(docs.select("doc_id", "source", file.alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"), "text"))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "mix_file", "mix_row")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash", near_duplicates),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding),
]

#: SimHash and BPE are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage wrote on its way goes, and its predecessor's result."""
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for _, stage in STAGES[:-1]:
        after = shared_dir(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(after)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(after), after
    return STAGES[-1][1](spark, docs, sf_dir)
