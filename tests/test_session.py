import os

import pytest
from pyspark.sql import functions as F

from veridelta import session


def test_dropped_checkpoint_is_gone(spark):
    df = session.cut(spark.range(5))
    at = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(at) and df.count() == 5
    session.drop(df)
    assert not os.path.isdir(at)
    session.drop(spark.range(3).cache())  # nothing to delete


def test_small_looks_at_rows_and_bytes(spark):
    hinted = lambda df: "hint" in session.small(df, 10, 150)._jdf.queryExecution().logical().toString().lower()
    assert hinted(spark.range(10)) and not hinted(spark.range(11)) and hinted(spark.range(0))
    assert not hinted(spark.range(2).withColumn("s", F.expr("repeat('x', 100)")))


def test_shared_folder_is_needed_off_a_local_master(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

        @staticmethod
        def getConf():
            return {}

    fake = type("Spark", (), {"sparkContext": Context, "conf": {}})
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(fake)
