import pytest
from pyspark.sql import functions as F

from factloom.sources import tables


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_row_group_in_many_splits_is_dealt_to_all_tasks(spark, tmp_path, small_splits):
    path = str(tmp_path / "t.parquet")
    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    assert rows.rdd.getNumPartitions() > 8
    dealt = tables.spread(rows, "id")
    counts = [x["count"] for x in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 20_000 and max(counts) < 2 * 20_000 / 8
    even = tables.spread(spark.range(0, 8_000, 1, 8).toDF("id"), "id")
    assert "Exchange" not in even._jdf.queryExecution().executedPlan().toString()
