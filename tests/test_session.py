import pytest

from passagework.session import shared_checkpoints, spread_lookup


def test_lookup_of_hot_and_null_keys(spark):
    left = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('k', id) END AS key")
    right = spark.createDataFrame([("hot", 1), ("k5", 2), ("other", 3), (None, 4)], "key string, value int")
    out = spread_lookup(left, right, "key", "id", salts=4)
    assert out.count() == 5000 and out.where("value = 1").count() == 1667 and out.where("value = 2").count() == 1 and out.where("value > 2").count() == 0
    assert spread_lookup(left.limit(0), right, "key", "id").count() == 0 and spread_lookup(left, right.limit(0), "key", "id").where("value is not null").count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_checkpoints(Session())
