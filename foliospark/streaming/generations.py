"""Jobs of several generations over a stream: what comes late may neither speak nor settle; deltas are written once a batch, also on replay.

A job goes on in batches of work, each a generation. Only the generation that holds the job counts; one begun later takes
it over, and what an older one still sends is dropped. After the job has settled, its own generation's late items are still taken in, but change nothing
that was said about it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps states of this kind, with lives of their own.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = "job string, seq long, generation long, kind string, page int, items array<string>, error string"
_DELTA = "job string, generation long, seq long, what string, page int, item string, late boolean"


class _Job(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # what isn't touched for so long is forgotten by the store itself; a settled job's timer is earlier
        self.state = handle.getValueState("job", "generation long, phase string, page int, last_new int, error string", 2 * self.keep_ms)
        self.seen = handle.getMapState("seen", "item string", "page int", 2 * self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        messages = pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False)
        generation, phase, page, last_new, error = tuple(self.state.get()) if self.state.exists() else (-1, "none", 0, 0, None)
        out = []
        for m in messages:
            if m.kind == "start":
                if m.generation > generation:
                    generation, phase, error = int(m.generation), "running", None
                continue
            if m.generation != generation:
                continue  # of a generation that doesn't hold the job
            running = phase == "running"
            if m.kind == "items":
                new = [x for x in dict.fromkeys(m.items if m.items is not None else []) if not self.seen.containsKey((x,))]
                for x in new:
                    self.seen.updateValue((x,), (int(m.page),))
                    out.append((key[0], generation, m.seq, "item", int(m.page), x, not running))
                if running:
                    page, last_new, error = int(m.page), len(new), None
            elif running and m.kind == "error":
                error = m.error
                out.append((key[0], generation, m.seq, "error", None, m.error, False))
            elif running and m.kind in ("completed", "failed", "killed"):
                phase = m.kind
                out.append((key[0], generation, m.seq, m.kind, page, None, False))
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        if generation >= 0:
            self.state.update((generation, phase, page, last_new, error))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _DELTA.split(", ")]).astype({"page": "Int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A settled job is kept for a while only; one that runs again isn't forgotten."""
        if self.state.exists() and self.state.get()[1] != "running":
            self.state.clear()
            self.seen.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in _DELTA.split(", ")])

    def close(self) -> None:
        pass


def deltas(messages: DataFrame, keep_ms: int = 3_600_000) -> DataFrame:
    """What a stream of messages (MESSAGE: kind is start, items, error, completed, failed or killed) adds to its jobs, in order of seq within a batch.

    Rows (job, generation, seq, what, page, item, late): each item of a job once, where it came first (late: after the job had
    settled); errors of pages; the outcome, once, with the last page that came. Settled jobs are forgotten after keep_ms.
    The session's state store must be STORE.
    """
    return messages.groupBy("job").transformWithStateInPandas(_Job(keep_ms), _DELTA, "append", "ProcessingTime")


def write_deltas(rows: DataFrame, path: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Starts a query that writes a stream of deltas below path, a folder for each batch. A batch that is run again replaces its own folder, so that nothing stands twice.

    It runs until it is stopped: timers need batches without data, with which availableNow never ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def read_deltas(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """Deltas of the batches from a cursor on (batch is a column); folders before it aren't read."""
    return spark.read.option("basePath", path).schema(f"{_DELTA}, batch int").parquet(path).filter(F.col("batch") >= since)
