"""Shared folder, temporary tables, filters by ids and what workers hold."""

import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillon.llm import common


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[3,2,1000]", "yarn", "k8s://x"])
def test_a_cluster_without_shared_folder_is_an_error(master):
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(spark)


def test_scratch_drops_its_tables(spark):
    where = lambda t: t._shared_path.removeprefix("file://")
    with pytest.raises(RuntimeError), common.Scratch(spark) as scratch:
        a, b = scratch.written(spark.range(3), "a"), scratch.written(spark.range(4), "b")
        assert a.count() == 3 and os.path.isdir(where(a))
        scratch.drop(a, None, spark.range(1))
        assert not os.path.exists(where(a)) and b.count() == 4
        raise RuntimeError
    assert not os.path.exists(where(b))
    kept = common.written(spark.range(5), "kept")
    assert kept.count() == 5


def test_only_and_the_rest(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "k int, v string")
    ids = spark.createDataFrame([(2,), (9,)], "id long")
    for few in (common.FEW_IDS, 0):
        monkeypatch.setattr(common, "FEW_IDS", few)
        assert sorted(r.v for r in common.only(df, ids, "k").collect()) == ["b", "d"]
        assert sorted(r.v for r in common.only(df, ids, "k", but=True).collect()) == ["a", "c"]


def test_one_thing_is_held():
    made = []
    for key in ("a", "a", "b", "a"):
        common.held(("test", key), lambda key=key: made.append(key) or key)
    assert made == ["a", "b", "a"]


def test_what_is_held_goes_after_the_last_task(monkeypatch):
    monkeypatch.setattr(common, "KEEP_S", 0.2)
    with common.working():
        common.held(("test", "x"), lambda: [1])
        time.sleep(1)
        assert common.held(("test", "x"), lambda: [2]) == [1]
    with common.working():
        assert common.held(("test", "x"), lambda: [3]) == [1]
    time.sleep(1.5)
    assert common.held(("test", "x"), lambda: [4]) == [4]


def test_shuffle_files_go_only_within(spark):
    before = spark.conf.get(common.CLEANUP, "false")
    with common.cleaning(spark):
        assert spark.conf.get(common.CLEANUP) == "true"
    assert spark.conf.get(common.CLEANUP) == before
    assert common.written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "t").count() == 7
