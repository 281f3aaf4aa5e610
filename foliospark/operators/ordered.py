"""Orders over all partitions: numbers, previous rows and dominance counts of groups of any size, without a task that sees a whole group.

Rows are sorted into ranges. What a task must know of those before it is what their last groups leave to it: a few
numbers a partition, summed over the partitions and given to the first row of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written

#: Bits of a number that one round of dominance() looks at.
DIGIT = 6


def sorted_rows(rows: DataFrame, *order: str) -> DataFrame:
    """rows, written in order, with part (ranges in ascending order) and idx (from 0 in each)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return written(ranged.withColumn("part", F.shiftright(at, 33).cast("int")).withColumn("idx", at.bitwiseAND((1 << 33) - 1)))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with n, their number in the group by the order (from 0; the order must tell its rows apart)."""
    placed = sorted_rows(rows, group, *order)
    ends = placed.groupBy(group, "part").agg(F.min("idx").alias("first"), F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ends.select(F.col(group).alias("__group"), F.col("part").alias("__part"), (before - F.col("first")).alias("__by"))
    met = placed.join(offsets, placed[group].eqNullSafe(F.col("__group")) & (placed["part"] == F.col("__part")))
    return met.withColumn("n", F.col("idx") + F.col("__by")).drop("part", "idx", "__group", "__part", "__by")


def previous(rows: DataFrame, same: list[str], order: str, name: str = "p") -> DataFrame:
    """rows with the order's value (a long) of the row before with equal columns, -1 for the first."""
    placed = sorted_rows(rows, *same, order)
    key = F.struct(*same)
    last = placed.groupBy("part").agg(F.max_by(F.struct(key.alias("key"), F.col(order).alias("value")), "idx").alias("last"))
    carried = last.select("part", F.lag("last").over(Window.orderBy("part")).alias("carried"))  # one row a partition
    in_part = Window.partitionBy("part").orderBy("idx")
    met = placed.withColumn("__own", F.struct(key.alias("key"), F.col(order).alias("value"))).withColumn("__before", F.lag("__own").over(in_part))
    met = met.join(F.broadcast(carried), "part").withColumn("__before", F.coalesce("__before", "carried"))
    there = F.col("__before.key").eqNullSafe(F.col("__own.key"))
    return met.withColumn(name, F.when(there, F.col("__before.value")).otherwise(F.lit(-1)).cast("long")).drop("part", "idx", "__own", "__before", "carried")


def dominance(rows: DataFrame, group: str, n: str = "n", p: str = "p", digit: int = DIGIT) -> DataFrame:
    """group, n, below: for each row how many rows of its group have both a smaller n and a smaller p. n is unique in a group, from 0; rows of equal p count each other only if p is -1 (they aren't asked for then).

    Two numbers first differ in one of their digits. For each digit, rows with the same digits above it are put
    into order by p, and each counts the rows before it with a smaller digit.
    """
    base = written(rows.select(F.col(group).alias("g"), F.col(n).cast("long").alias("n"), F.col(p).cast("long").alias("p")))
    most = base.agg(F.max("n")).first()[0] or 0
    found, base_of = [], 1 << digit
    for shift in range(0, max(1, int(most).bit_length()), digit):
        placed = sorted_rows(base.withColumn("above", F.shiftright("n", shift + digit)), "g", "above", "p", "n")
        small = F.shiftright("n", shift).bitwiseAND(base_of - 1)
        # what the last group of each partition leaves to the same group in later ones
        last = placed.groupBy("part").agg(F.max_by(F.struct("g", "above"), "idx").alias("last"), F.min_by(F.struct("g", "above"), "idx").alias("first"))
        left = placed.join(F.broadcast(last.select("part", "last")), "part").filter(F.struct("g", "above").eqNullSafe(F.col("last"))).groupBy("part", "last", small.alias("d")).agg(F.count("*").alias("c"))
        every = last.select("part", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(base_of - 1).cast("long"))).alias("d"))
        marks = left.select(F.col("last").alias("key"), "part", "d", "c", F.lit(1).alias("kind")).union(every.select(F.col("first").alias("key"), "part", F.col("d"), F.lit(0).cast("long"), F.lit(0)))
        before = F.sum("c").over(Window.partitionBy("key", "d").orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, -1))
        carried = marks.withColumn("before", F.coalesce(before, F.lit(0))).filter("kind = 0").groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "before"))), lambda x: x["before"]).alias("carried"))
        heads = carried.select("part", F.lit(0).cast("long").alias("idx"), "carried")
        asked = placed.withColumn("d", small.cast("int")).join(F.broadcast(heads), ["part", "idx"], "left").select("part", "idx", "g", "above", "n", "p", "d", "carried")
        # joins by broadcast keep the rows of a file in order; sorting says so, and makes it sure
        asked = asked.repartition("part").sortWithinPartitions("part", "idx")
        ids = asked.withColumn("new", F.when(F.struct("g", "above").eqNullSafe(F.lag(F.struct("g", "above")).over(Window.partitionBy("part").orderBy("idx"))), F.lit(False)).otherwise(F.lit(True)))
        counted = ids.select("part", "new", "d", "carried", "g", "n").mapInArrow(_count_smaller(base_of), f"g {base.schema['g'].dataType.simpleString()}, n long, below long")
        found.append(counted)
    return reduce(DataFrame.union, found).groupBy(F.col("g").alias(group), "n").agg(F.sum("below").alias("below"))


def _count_smaller(digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = None, np.zeros(digits, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, new, d = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            starts = new.copy()
            starts[0] = starts[0] or parts[0] != part
            starts[1:] |= parts[1:] != parts[:-1]
            begin = np.flatnonzero(starts)
            segment = np.cumsum(starts) - 1  # -1: goes on from the batch before
            carried = {}
            for i in np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False)).tolist():
                carried[i] = np.array(batch.column(3)[i].as_py(), np.int64)
            below = np.zeros(len(d), np.int64)
            base = np.zeros((len(begin) + 1, digits), np.int64)  # counts with which each segment begins
            base[0] = counts
            for k, i in enumerate(begin.tolist()):
                if i in carried:
                    base[k + 1] = carried[i]
            smaller = np.zeros((len(begin) + 1, digits + 1), np.int64)
            smaller[:, 1:] = np.cumsum(base, axis=1)
            at = np.concatenate([[0], begin])
            for v in np.unique(d).tolist():
                run_ = np.concatenate([[0], np.cumsum(d < v)])
                own = np.flatnonzero(d == v)
                below[own] = run_[own] - run_[at[segment[own] + 1]] + smaller[segment[own] + 1, v]
            tail = d[begin[-1] if len(begin) else 0 :]
            counts = base[-1] + np.bincount(tail, minlength=digits)
            part = parts[-1]
            yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(5), pa.array(below)], ["g", "n", "below"])

    return run


def distinct_between(reads: DataFrame, store: str, key: str, order: str) -> DataFrame:
    """reads with distance: how many distinct other keys of the store were read since the key was read before (null the first time).

    A store that forgets the least recently read key still has the key if it has room for more than distance keys. order must
    tell the reads of a store apart. A key stands between two reads if it is read there for the first time since, that is
    if its own read before lies before the first of the two.
    """
    own = previous(written(numbered(reads, store, order)), [store, key], "n")
    own = written(own)
    below = dominance(own, store)
    met = own.join(below.withColumnsRenamed({store: "__store", "n": "__n"}), own[store].eqNullSafe(F.col("__store")) & (F.col("n") == F.col("__n")), "left")
    return met.withColumn("distance", F.when(F.col("p") >= 0, F.col("below") - F.col("p") - 1)).drop("__store", "__n", "below", "n", "p")
