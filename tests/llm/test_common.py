import threading

import pytest

import corpus_pipeline as pipeline
from verdigris.llm import common


class Conf:
    def __init__(self, **values):
        self.values = {k.replace("_", "."): v for k, v in values.items()}

    def get(self, key, default=None):
        return self.values.get(key, default)


class Session:
    def __init__(self, **values):
        self.conf = Conf(**values)


def test_no_local_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]", ""):
        with pytest.raises(ValueError):
            common.shared_dir(Session(spark_master=master))
    assert common.shared_dir(Session(spark_master="local[2]")) != common.shared_dir(Session(spark_master="local"))
    session = Session(spark_master="yarn")
    session.conf.values["spark.checkpoint.dir"] = "hdfs://a/b/"
    assert common.shared_dir(session).startswith("hdfs://a/b/verdigris-")


def test_removed_folders_leave_no_table(spark):
    path = common.shared_dir(spark)
    held = lambda: [r["tableName"] for r in spark.sql("SHOW TABLES LIKE 'verdigris_*'").collect() if path.rsplit("-", 1)[1] in r["tableName"]]
    docs = spark.createDataFrame([("a",), ("a",), (None,)], "text string")
    assert common.distinct_texts(docs, f"{path}/texts").count() == 2
    common.written(docs, f"{path}/texts-other")
    assert len(held()) == 1
    common.remove(spark, f"{path}/texts-other")
    common.remove(spark, f"{path}/text")
    assert len(held()) == 1 and spark.table(held()[0]).count() == 2
    common.remove(spark, path)
    assert held() == []


def test_threads_keep_their_own_folders(spark, monkeypatch):
    gone = []
    monkeypatch.setattr(pipeline, "remove", lambda s, path: gone.append(path))
    mine, other = [pipeline._folder(spark)], []
    thread = threading.Thread(target=lambda: other.extend([pipeline._folder(spark), pipeline._folder(spark)]))
    thread.start()
    thread.join()
    assert gone == other[:1] and len({*mine, *other}) == 3
    pipeline._clear(spark)
    assert gone == [*other[:1], *mine]


def test_names_inside_meet_none_of_the_input(spark):
    df = spark.createDataFrame([(1, 2, "t")], ["HIT", "hit_", "text"])
    assert common.unused("hit", df) == "hit__" and common.unused("x", df) == "x"
    packed, back = common.set_aside(df, "text")
    assert [tuple(r) for r in back(packed).collect()] == [(1, 2, "t")] and back(packed).columns == df.columns
    only, back = common.set_aside(df.select("text"), "text")
    assert [tuple(r) for r in back(only).collect()] == [("t",)]


def test_tasks_follow_the_size_of_the_input(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert common.tasks_for(docs) == common.shuffle_partitions(spark)
    monkeypatch.setattr(common, "TASK_BYTES", 1000)
    assert 50 < common.tasks_for(docs) < 5000
    assert common.tasks_for(spark.createDataFrame([("a",)], "text string")) >= common.shuffle_partitions(spark)
    path = common.shared_dir(spark)
    assert common.distinct_texts(docs.limit(30), f"{path}/texts").count() <= 30
    common.remove(spark, path)
