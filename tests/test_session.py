"""Sessions' helpers."""

import types

import pytest

from quillspark import session


def test_checkpoint_folder():
    def fake(master, conf):
        sc = types.SimpleNamespace(master=master, dir=None)
        sc.getCheckpointDir = lambda: sc.dir
        sc.setCheckpointDir = lambda d: setattr(sc, "dir", d)
        return types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda k, d: conf.get(k, d)))

    assert session.checkpoint_dir(fake("spark://host:7077", {"spark.checkpoint.dir": "/shared"})) == "/shared"
    assert session.checkpoint_dir(fake("local[4]", {}))
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(fake("local-cluster[3,2,1024]", {}))


def test_spread_runs_nothing(spark):
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "spread")
    grouped = spark.range(100).groupBy("id").count()
    assert session.spread(grouped, "id") is grouped
    assert list(jobs.getJobIdsForGroup("spread")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    few = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert session.spread(few, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
