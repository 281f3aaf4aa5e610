"""Operators that look at a key's rows in order of time: loads, reuse, lifetimes, deltas; and a stateful limiter of streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..shared import written


def rate_rule(x: Column) -> Column:
    """limit and interval (milliseconds) of a text like 3/1000 or 1000; null for no limit."""
    head, rest = F.substring_index(x, "/", 1).try_cast("double"), F.substring_index(x, "/", -1).try_cast("double")
    limit = F.when(F.instr(x, "/") > 0, F.floor(head)).otherwise(F.lit(1)).cast("long")
    return F.when((limit > 0) & (rest > 0), F.struct(limit.alias("limit"), rest.alias("interval")))


def window_load(calls: DataFrame, key: str, at: str, limit: int, interval: int) -> DataFrame:
    """calls with load, the calls of their key in the last `interval` (at their own time too), and over: more than the limit.

    What a sliding log of calls holds when each arrives; ties in time count for each other.
    """
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-interval + 1, 0)
    return calls.withColumn("load", F.count("*").over(w)).withColumn("over", F.col("load") > limit)


def admitted_stream(calls: DataFrame, key: str, at: str, limit: int, interval: int) -> DataFrame:
    """A stream of (key string, at long) with admitted: when a limiter of `limit` calls in `interval` milliseconds lets each through, with the window as state.

    A call waits for the one before and, if the window is full, until its oldest call leaves it.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0]) if state.exists else deque()
        for frame in frames:
            out = []
            for t in sorted(frame[at]):
                arrived = t
                if held:
                    t = max(t, held[-1])
                if len(held) == limit:
                    t = max(t, held.popleft() + interval)
                held.append(t)
                out.append((k[0], arrived, t))
            yield pd.DataFrame(out, columns=[key, at, "admitted"])
        state.update((list(held),))

    return calls.groupBy(key).applyInPandasWithState(run, f"{key} string, {at} long, admitted long", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def reuse_distance(reads: DataFrame, store: str, key: str, order: str) -> DataFrame:
    """reads with gap: how many reads of the store lie between a key's read and the one before (null for the first).

    A store that forgets the least recently read key, with room for gap + 1 keys, still has it.
    """
    rows = reads.withColumn("__n", F.row_number().over(Window.partitionBy(store).orderBy(order)))
    before = F.lag("__n").over(Window.partitionBy(store, key).orderBy("__n"))
    return rows.withColumn("gap", (F.col("__n") - before - 1).cast("long")).drop("__n")


def cache_lives(reads: DataFrame, key: str, at: str, ttl: int) -> DataFrame:
    """Distinct (key, at) of reads (at a long) with loaded: whether a cache must load the key then, and life, the number of the load that serves it (from 1).

    A loaded value serves reads for less than ttl from its load, however often it is read. So the next load is the first read
    that is ttl or more later; the loads are what these steps reach from a key's first read, found by doubling the steps: as many
    rounds as the longest row of loads has binary digits.
    """
    later = F.min(at).over(Window.partitionBy(key).orderBy(at).rangeBetween(ttl, Window.unboundedFollowing))
    points = written(reads.filter(F.col(at).isNotNull()).select(key, at).distinct().withColumn("__to", later))
    loads = written(points.groupBy(F.col(key).alias("__key")).agg(F.min(at).alias("__at")))
    jumps = points.filter("__to IS NOT NULL").select(F.col(key).alias("__key"), F.col(at).alias("__at"), "__to")
    same = lambda a, b, x, y: a["__key"].eqNullSafe(b["__k"]) & (a[x] == b[y])
    while True:
        by = jumps.select(F.col("__key").alias("__k"), F.col("__at").alias("__a"), F.col("__to").alias("__t"))
        new = written(loads.join(by, same(loads, by, "__at", "__a")).select("__key", F.col("__t").alias("__at")).distinct())
        if new.isEmpty():
            break
        # steps are distinct in number on each row of loads, so nothing is reached twice
        loads = written(loads.union(new))
        jumps = written(jumps.join(by, same(jumps, by, "__to", "__a")).select("__key", "__at", F.col("__t").alias("__to")))
    met = points.drop("__to").join(loads, points[key].eqNullSafe(loads["__key"]) & (points[at] == loads["__at"]), "left")
    loaded = F.col("__at").isNotNull()
    life = F.sum(loaded.cast("long")).over(Window.partitionBy(key).orderBy(at))
    return met.select(key, at, loaded.alias("loaded"), life.alias("life"))


def lifetimes(reads: DataFrame, key: str, at: str, ttl: int, order: str) -> DataFrame:
    """reads with life: the number of a key's stretch of reads, each less than ttl after the one before, and fresh: whether it is the first of its stretch.

    A cache whose entries live on as long as they are read has a miss where fresh is set.
    """
    w = Window.partitionBy(key).orderBy(at, order)
    rows = reads.withColumn("fresh", F.coalesce(F.col(at) - F.lag(at).over(w) >= ttl, F.lit(True)))
    return rows.withColumn("life", F.sum(F.col("fresh").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def distinct_stream(rows: DataFrame, key: Column, at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key of a stream, keys forgotten once the watermark passes them."""
    return rows.withColumn("__key", key).withWatermark(at, late).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def visible(rows: DataFrame, finished: str, now: Column, keep_ms: int) -> DataFrame:
    """Results that finished within keep_ms before now, or haven't finished."""
    return rows.filter(F.col(finished).isNull() | (F.unix_millis(now) - F.unix_millis(F.col(finished)) < keep_ms))


def delta(rows: DataFrame, order: str, since: int) -> DataFrame:
    """Rows that a cursor hasn't seen; the next cursor is the largest order plus one."""
    return rows.filter(F.col(order) >= since)
