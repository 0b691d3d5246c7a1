import os

import pytest

from inkledger.llm import shared


def test_sweep_deletes_what_is_left(spark):
    shared.sweep(spark)
    a, b = shared.materialize(spark.range(3).toDF("x"), "a"), shared.materialize(spark.range(4).toDF("x"), "b")
    shared.discard(spark, a)
    assert b.count() == 4 and shared.sweep(spark) == 1 and shared.sweep(spark) == 0
    assert not os.path.exists(b.inkledger_dir.removeprefix("file://"))


def test_a_cluster_must_name_its_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="share"):
        shared.shared_root(Session())
