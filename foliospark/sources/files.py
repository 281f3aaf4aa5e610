"""JSON files read whole; those that can't be read are set aside with their bytes, never taken for empty ones.

Files lie loose below a path, or in bundles: many small ones, each with its name and all its bytes, as rows of a few Parquet files. A loose file
costs the same whatever it holds (a local file system without Hadoop's native library starts a process for each file, check sum and folder that it
makes), so that files that are many and small belong in bundles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written

#: Why a file is set aside.
REASONS = ("NOT_UTF8", "EMPTY", "NOT_JSON", "OTHER_KIND")


#: A bundle holds as many files at most.
BUNDLE_FILES = 100_000


def read_json(spark: SparkSession, path: str, kind: str = "array<variant>", glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """Values (file, value) and files set aside (file, reason, content, modified), of the files below path that are JSON of a kind (a variant's type).

    Files are looked at once; both results are written beside each other and read the same look. A file that isn't UTF-8, is blank, isn't
    JSON, or has another kind at the top (an object where a list is due) is set aside as it is; a list without items is a value. A mark of
    byte order is passed over.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    both = _looked(files, kind)
    # a scan leaves out files of no bytes, which its listing (the driver has it anyway) names
    alike = lambda x: F.regexp_replace(x, "^file:/+", "file:/")
    listed = spark.createDataFrame([(x,) for x in files.inputFiles()], "file string").select(alike(F.col("file")).alias("file"))
    hollow = listed.join(both.select(alike(F.col("file")).alias("file")), "file", "left_anti").select("file", F.lit(REASONS[1]).alias("reason"), F.lit(b"").alias("content"), F.lit(None).cast("timestamp").alias("modified"))
    values, aside = _parted(both)
    return values, aside.union(hollow)


def bundle(files: DataFrame, path: str) -> None:
    """Writes files (path, content, modificationTime, as Spark's binaryFile reads them; the last may be missing) into bundles below path, each as it is. A null content is a file of no bytes."""
    modified: Column = F.col("modificationTime") if "modificationTime" in files.columns else F.current_timestamp()
    rows = files.select("path", F.coalesce("content", F.lit(b"")).alias("content"), modified.alias("modificationTime"))
    rows.write.option("maxRecordsPerFile", BUNDLE_FILES).parquet(path)


def read_bundled_json(spark: SparkSession, path: str, kind: str = "array<variant>") -> tuple[DataFrame, DataFrame]:
    """The same as read_json, of the files in the bundles below path; files of no bytes are rows like any other."""
    return _parted(_looked(spark.read.schema("path string, content binary, modificationTime timestamp").parquet(path), kind))


def _looked(files: DataFrame, kind: str) -> DataFrame:
    """file, value, reason, content, modified: each file looked at once, as a written table; either value or reason is null."""
    bare = F.when(F.substring("content", 1, 3) == F.lit(b"\xef\xbb\xbf"), F.expr("substring(content, 4)")).otherwise(F.col("content"))
    text = F.try_validate_utf8(bare.cast("string"))
    value = F.try_parse_json(F.col("text"))
    looked = files.select(F.col("path").alias("file"), "content", F.col("modificationTime").alias("modified"), text.alias("text")).withColumn("v", value)
    fits = F.try_variant_get("v", "$", kind)
    reason = F.when(F.col("text").isNull(), REASONS[0]).when(F.btrim(F.col("text")).rlike(r"\A\s*\z"), REASONS[1]).when(F.col("v").isNull(), REASONS[2]).when(fits.isNull(), REASONS[3])
    return written(looked.withColumn("reason", reason).select("file", F.when(F.col("reason").isNull(), F.col("v")).alias("value"), "reason", F.when(F.col("reason").isNotNull(), F.col("content")).alias("content"), "modified"))


def _parted(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    return both.filter("reason IS NULL").select("file", "value"), both.filter("reason IS NOT NULL").select("file", "reason", "content", "modified")
