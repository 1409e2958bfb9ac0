import pytest
from pyspark.sql import functions as F

from loomwork.operators import ordered as od
from loomwork.streaming import limits, runs


def test_limiter_on_a_stream_equals_the_batch_rule(spark, tmp_path):
    rows = [(i, i % 3, float(i * 7 % 90)) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, user_id bigint, at double")
    df.write.parquet(str(tmp_path / "calls"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "calls"))
        got = runs.appended(limits.limited(stream, 3, 20.0), "limits")
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in od.rate_limit(df, "user_id", 3, 20.0).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("size", ["1 hour", "1 day"])
def test_windows_of_a_stream_equal_those_of_a_batch(spark, size):
    path = "/root/testdata/sf0.001/events.parquet"
    got = runs.updated(runs.tumbling(runs.events(spark, path, "40 days"), size), "windows", ["start", "event_type"])
    want = runs.tumbling(spark.read.parquet(path).withColumn("at", F.col("ts").cast("timestamp")), size)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
