from types import SimpleNamespace

import pytest

from tidemill.session import discard, publish, published, shared_dir, written


def asking(master, folder=None):
    conf = {"spark.checkpoint.dir": folder} if folder else {}
    return SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            shared_dir(asking(master))
        assert shared_dir(asking(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(asking("local[4]")).startswith("file://")


def test_published_text_is_swapped(spark, tmp_path):
    at = f"file://{tmp_path}/deep/CURRENT"
    assert published(spark, at) is None
    publish(spark, at, "one")
    publish(spark, at, "zwei é")
    assert published(spark, at) == "zwei é"
    assert sorted(p.name for p in (tmp_path / "deep").iterdir() if not p.name.startswith(".")) == ["CURRENT"]
    discard(spark, f"file://{tmp_path}/deep", f"file://{tmp_path}/nothing")
    assert published(spark, at) is None


def test_written_keeps_rows(spark):
    assert written(spark.range(5).toDF("a"), "t").count() == 5
