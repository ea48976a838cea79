import os

import pytest
from frametide.sources import scratch
from frametide.streaming import stateful


class Cluster:
    """A session of a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Cluster)
    Cluster.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        scratch.shared_dir(Cluster)
    Cluster.sparkContext.master = "local[2]"
    assert scratch.shared_dir(Cluster).startswith("file://")


def test_discarded_tables_are_gone(spark):
    kept, gone = (scratch.written(spark.range(3), "t") for _ in range(2))
    folder = gone.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    scratch.discard(gone, None, spark.range(1))
    assert not os.path.exists(folder) and kept.count() == 3


def test_a_stream_keeps_only_what_it_appended(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 4)], "session_id long, frame int, value int")
    out = stateful.through_stream(rows, stateful.stream_counter_decrements)
    assert [tuple(r) for r in out.collect()] == [(1, 1, 1)]
    at = out.inputFiles()[0].removeprefix("file://").rsplit("/out/", 1)[0]
    assert os.listdir(at) == ["out"]
