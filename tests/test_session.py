from types import SimpleNamespace

import pytest

from recordloom import session


def fake(master, conf=None, jvm_dir=None):
    held = {"dir": jvm_dir}
    return SimpleNamespace(
        conf=SimpleNamespace(get=(conf or {}).get),
        sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None), getCheckpointDir=lambda: held["dir"], setCheckpointDir=lambda d: held.update(dir=d)),
    )


def test_the_clusters_folder_is_used():
    assert session.shared_dir(fake("spark://x", {session.CHECKPOINT_KEY: "hdfs://a/b/"})) == "hdfs://a/b"
    assert session.shared_dir(fake("spark://x", jvm_dir="s3://c")) == "s3://c"
    with pytest.raises(ValueError):
        session.shared_dir(fake("yarn"))
    s = fake("local[2]")
    assert session.shared_dir(s).startswith("file:///") and session.shared_dir(s) == session.shared_dir(s)


def test_written_tables_and_task_counts(spark):
    df = session.materialize(spark.range(10), "t")
    assert df.count() == 10 and session.path_exists(spark, session.shared_dir(spark))
    assert session.task_count(0, spark, 100) == 1 and session.task_count(1000, spark, 100) == 10


def test_small_files_and_release(spark):
    at = session.new_path(spark, "texts")
    assert session.put_text(spark, f"{at}/a.txt", "one\ntwo") and not session.put_text(spark, f"{at}/a.txt", "other")
    assert session.get_text(spark, f"{at}/a.txt") == "one\ntwo"
    session.move_path(spark, f"{at}/a.txt", f"{at}/deep/b.txt")
    assert session.path_exists(spark, f"{at}/deep/b.txt") and not session.path_exists(spark, f"{at}/a.txt")
    session.release(spark)
    assert not session.path_exists(spark, at)


def test_spread_raises_the_tasks_with_the_rows(spark):
    df = spark.range(100)
    assert session.spread(df, 100, "id") is df
    assert session.spread(df, 100, "id", rows_per_task=10).rdd.getNumPartitions() == 10
