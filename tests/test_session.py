from types import SimpleNamespace

import pytest

from tamis.session import materialize, release, shared_dir


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://there:7077", getCheckpointDir=lambda: None)
    bare = SimpleNamespace(conf={}, sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(bare)
    assert shared_dir(SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://x/y/"}, sparkContext=context)) == "hdfs://x/y"


def test_released_tables_are_gone(spark):
    one, two = materialize(spark.range(5), "a"), materialize(spark.range(7), "b")
    assert one.count() == 5
    release(one)
    with pytest.raises(Exception):
        spark.read.parquet(one.inputFiles()[0]).count()
    assert two.count() == 7
