"""Jobs of several generations over a stream: late, stale and repeated batches."""

import glob
import os
import time

import pytest

from foliospark.streaming import generations


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, generations.STORE)
    yield
    spark.conf.set(name, before)


def test_generations(spark, tmp_path, store):
    m = lambda seq, generation, kind, page=None, items=None, error=None, job="a": (job, seq, generation, kind, page, items, error)
    batches = [
        [m(1, 1, "start"), m(2, 1, "items", 1, ["x", "y", "x"]), m(3, 1, "error", error="HTTP"), m(4, 5, "start", job="b"), m(5, 4, "items", 1, ["stale"], job="b")],
        [m(6, 2, "start"), m(7, 1, "items", 2, ["of the first generation"]), m(8, 1, "completed"), m(9, 2, "items", 2, ["y", "z"])],  # the first one comes too late
        [m(10, 2, "completed"), m(11, 2, "items", 3, ["late"]), m(12, 2, "error", error="late too"), m(13, 2, "failed")],  # settled: items only
        [m(14, 3, "start"), m(15, 3, "items", 3, ["late", "w"]), m(16, 3, "killed"), m(17, 5, "failed", job="b"), m(18, 9, "items", 1, ["unknown"], job="c")],
    ]
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run(new):
        for rows in new:
            spark.createDataFrame(rows, generations.MESSAGE).coalesce(1).write.mode("append").parquet(source)
            time.sleep(1.1)  # files are taken by their times
        stream = spark.readStream.schema(generations.MESSAGE).option("maxFilesPerTrigger", 1).parquet(source)
        query = generations.write_deltas(generations.deltas(stream), path, checkpoint)
        wanted, read, until = sum(map(len, new)) or len(batches[-1]), 0, time.time() + 90
        while read < wanted and time.time() < until:
            time.sleep(0.5)
            read = sum(p["numInputRows"] for p in query.recentProgress)
        query.stop()
        assert query.exception() is None and read == wanted

    run(batches[:2])
    first = generations.read_deltas(spark, path)
    cursor = max(r.batch for r in first.collect()) + 1
    run(batches[2:])  # the state goes on in a new query
    said = lambda df: [(r.job, r.generation, r.what, r.page, r["item"], r.late) for r in df.orderBy("seq", "item").collect()]
    expected = [
        ("a", 1, "item", 1, "x", False), ("a", 1, "item", 1, "y", False), ("a", 1, "error", None, "HTTP", False), ("a", 2, "item", 2, "z", False),
        ("a", 2, "completed", 2, None, False), ("a", 2, "item", 3, "late", True), ("a", 3, "item", 3, "w", False), ("a", 3, "killed", 3, None, False), ("b", 5, "failed", 0, None, False),
    ]
    assert said(generations.read_deltas(spark, path)) == expected
    assert said(generations.read_deltas(spark, path, cursor)) == expected[4:]
    # the last batch again, as after a failure between its output and its commit
    commits = sorted((f for f in glob.glob(f"{checkpoint}/commits/*") if os.path.basename(f).isdigit()), key=lambda f: int(os.path.basename(f)))
    for f in (commits[-1], os.path.join(os.path.dirname(commits[-1]), f".{os.path.basename(commits[-1])}.crc")):
        if os.path.exists(f):
            os.remove(f)
    run([])
    assert said(generations.read_deltas(spark, path)) == expected
