"""Written tables: where they are and when they go."""

import os

import pytest

from foliospark.shared import _root, scratch, shared_dir, written


def folders(spark):
    return set(os.listdir(_root(spark).removeprefix("file://")))


def test_scratch(spark):
    df = spark.range(5)
    outside = written(df)
    before = folders(spark)
    with scratch(spark):
        inside = written(df)
        assert inside.count() == 5
        with scratch(spark):
            written(df)
            also = written(df, lasting=True)  # goes with the outer one
        assert also.count() == 5
        kept = written(inside.filter("id > 2"), lasting=True)
    assert kept.count() == 2 and outside.count() == 5
    assert len(folders(spark) - before) == 1  # the lasting one


def test_scratch_goes_after_errors(spark):
    before = folders(spark)
    with pytest.raises(RuntimeError), scratch(spark):
        written(spark.range(3))
        raise RuntimeError
    assert folders(spark) == before and "/" in shared_dir(spark)
