"""Tables that cut lineage, and bitsets."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gleanwork import bitset, storage


def session(master, named=None):
    conf = SimpleNamespace(get=lambda key, default=None: named)
    context = SimpleNamespace(master=master, applicationId="app", getConf=lambda: SimpleNamespace(get=lambda key: None))
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_shared_folder():
    """The session's own folder; a local master gets one where none is named, a cluster doesn't."""
    assert storage.shared_dir(session("spark://x:7077", "hdfs://x/shared/")) == "hdfs://x/shared"
    assert storage.shared_dir(session("local[4]")) == storage.shared_dir(session("local")) and storage.shared_dir(session("local")).startswith("file:///")
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://x:7077"):
        with pytest.raises(ValueError):
            storage.shared_dir(session(master))


def test_cut_frees_shuffles_and_leaves_settings(spark):
    before = spark.conf.get(storage.CLEANUP, None)
    rows = storage.cut(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert rows.count() == 7 and spark.conf.get(storage.CLEANUP, None) == before
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    assert storage.exists(spark, path) and storage.exists(spark, f"{path}/part-*")
    storage.drop_cut(rows)
    assert not storage.exists(spark, path)


def test_fitting_bits(spark):
    small, large = storage.cut(spark.range(10)), storage.cut(spark.range(20_000))
    assert bitset.fitting(small, 1 << 26) == 1 << 17 and bitset.fitting(large, 1 << 26) == 1 << 19 and bitset.fitting(large, 1 << 18) == 1 << 18
