import pytest
from pyspark.sql import functions as F

from tidemark.llm import common


def test_join_hot_equals_a_join(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 400).alias("k"), "id")
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).filter("k != 11")
    want = sorted(tuple(r) for r in rows.join(lookup.drop("n"), "k").select("k", "id", "low").collect())
    for share in (2, 10, 10_000):
        assert sorted(tuple(r) for r in common.join_hot(rows, lookup, "k", "n", share).select("k", "id", "low").collect()) == want
    assert common.join_hot(rows.limit(0), lookup.limit(0), "k", "n").count() == 0


def test_no_local_folder_is_shared_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session)
