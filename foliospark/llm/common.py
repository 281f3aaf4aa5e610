"""What the operators share: checked broadcasts, Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir, small_batches, spread, written  # noqa: F401

#: Lookup tables of up to this many rows (with bounded rows) are broadcast.
BROADCAST_ROWS = 100_000
#: Rows that hold arrays: up to this many elements in all.
BROADCAST_ELEMENTS = 500_000
#: Rows whose bytes aren't bounded: up to so many bytes in all.
BROADCAST_BYTES = 8 << 20
#: Beyond it a lookup join is salted: each lookup row is repeated this many times.
SALTS = 16
#: A key of more rows than 1 / HOT_KEYS of all, and than HOT_ROWS, is hot; there are fewer than HOT_KEYS of them.
HOT_KEYS, HOT_ROWS = 50_000, 1_000
#: Stands for a null document id inside the operators; the results have null again.
NO_ID = -(2**63)


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", elements: Column | None = None) -> DataFrame:
    """Joins a lookup table with one row for each key to rows of which one key may have a third.

    The lookup table must be cheap to count (a written table). It is broadcast if it has
    BROADCAST_ROWS rows at most, and BROADCAST_ELEMENTS elements where its rows hold arrays; else both
    sides get a salt, so that a hot key goes to SALTS tasks. A null key finds nothing.
    """
    fits = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if fits and elements is not None:
        fits = (small.agg(F.sum(elements)).first()[0] or 0) <= BROADCAST_ELEMENTS
    if fits:
        return big.join(F.broadcast(small), key, how)
    spread = [name for name, kind in big.dtypes if kind in ("bigint", "int", "string")]
    salt = F.pmod(F.xxhash64(F.lit(SALTS), *[F.col(f"`{name}`") for name in spread]), F.lit(SALTS)).cast("int")
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("__salt", salt).join(repeated, [key, "__salt"], how).drop("__salt")


def _fits(small: DataFrame, size: Column | None) -> bool:
    if size is None:
        return small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    n, total = small.agg(F.count("*"), F.sum(size)).first()
    return n <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], size: Column | None = None) -> DataFrame:
    """Inner join of two written tables, small with one row for each key, big with any number. size: the bytes of a row of small, where they aren't bounded.

    A small table of BROADCAST_ROWS rows (and BROADCAST_BYTES) at most is broadcast. Else hot keys are counted first; their
    rows in small, fewer than HOT_KEYS, are broadcast, or salted where they have more bytes; all other keys are
    shuffled, so that no task gets a hot key's rows.
    """
    if _fits(small, size):
        return big.join(F.broadcast(small), keys)
    most = max(HOT_ROWS, big.count() // HOT_KEYS)
    hot = big.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).drop("__n")
    hot = written(small.join(F.broadcast(hot), keys, "left_semi"))
    if hot.isEmpty():
        return big.join(small, keys)
    named = F.broadcast(hot.select(*keys))
    rest = big.join(named, keys, "left_anti").join(small, keys)
    if _fits(hot, size):
        return big.join(F.broadcast(hot), keys).unionByName(rest)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(SALTS)).cast("int")
    many = hot.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.join(named, keys, "left_semi").withColumn("__salt", salt).join(many, [*keys, "__salt"]).drop("__salt").unionByName(rest)


def anti_join(big: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of big whose key isn't in gone, a written table of few keys for many rows; broadcast up to BROADCAST_ROWS * 10 keys (of bounded size), else shuffled."""
    few = gone.limit(10 * BROADCAST_ROWS + 1).count() <= 10 * BROADCAST_ROWS
    return big.join(F.broadcast(gone) if few else gone, key, "left_anti")


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = make(batch)
            if out is not None and out.num_rows:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def range_buckets(df: DataFrame, column: str, n: int) -> list[float]:
    """At most n - 1 ascending bounds that cut a numeric column into about equal parts (only that column is read)."""
    if n < 2:
        return []
    return sorted(set(df.approxQuantile(column, [i / n for i in range(1, n)], 0.2 / n)))


def with_range(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """df with range (int), and the number of ranges: ascending ones of a numeric column, of about equal numbers of rows, four for each partition. One value's rows are in one range."""
    bounds = range_buckets(df, column, 4 * partitions(df.sparkSession)) or [0.0]
    ranged = df.withColumn("__at", F.col(column).cast("double"))
    ranged = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="__at", outputCol="__range").transform(ranged)
    return ranged.withColumn("range", F.col("__range").cast("int")).drop("__at", "__range"), len(bounds) + 1


def in_ranges(ranged: DataFrame, ranges: int, *order: str) -> DataFrame:
    """Neighbouring ranges in one partition, as many in each, partitions ascending, each sorted by range and the order."""
    n = partitions(ranged.sparkSession)
    at = F.floor(F.col("range") * F.lit(n) / F.lit(ranges)).cast("int")
    return ranged.repartitionById(n, at).sortWithinPartitions("range", *order)


class Shared:
    """Bytes of a bounded file, sent once to each executor; key tells them from others in a worker's store."""

    def __init__(self, spark: SparkSession, data: bytes):
        self.key, self.sent = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)

    @property
    def value(self) -> bytes:
        return self.sent.value


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
