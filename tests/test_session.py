"""Where lineage is cut."""

import pytest

from sparkloom import session


class Fake:
    """The parts of a session that the folder choice reads."""

    def __init__(self, master, named=None, current=None):
        self.chosen = []
        self.conf = type("Conf", (), {"get": lambda _, key, default=None: named})()
        self.sparkContext = type(
            "Context",
            (),
            {
                "master": master,
                "getCheckpointDir": lambda _: self.chosen[-1] if self.chosen else current,
                "setCheckpointDir": lambda _, path: self.chosen.append(path),
            },
        )()


def test_named_folder_is_used():
    fake = Fake("spark://host:7077", named="hdfs:///shared")
    assert session.checkpoint_dir(fake) == "hdfs:///shared" and fake.chosen == ["hdfs:///shared"]
    fake = Fake("spark://host:7077", named="hdfs:///shared", current="hdfs:///shared/a")
    assert session.checkpoint_dir(fake) == "hdfs:///shared" and not fake.chosen


def test_cluster_without_a_folder_is_an_error():
    with pytest.raises(ValueError):
        session.checkpoint_dir(Fake("spark://host:7077"))


def test_local_session_makes_one():
    fake = Fake("local[2]")
    assert session.checkpoint_dir(fake) == fake.chosen[0]


def test_cut_keeps_partitions(spark):
    frame = spark.range(100).repartition(4)
    kept = session.cut(frame)
    assert kept.rdd.getNumPartitions() == 4 and kept.count() == 100
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()


def test_stage_prunes_columns(spark):
    kept = session.stage(spark.range(10).selectExpr("id", "id * 2 AS twice"), "pairs")
    assert "twice" not in kept.select("id")._jdf.queryExecution().executedPlan().toString()
