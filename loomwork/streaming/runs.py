"""Structured Streaming runs over the files that there are, with results as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.operators.storage import new_folder


def events(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """The events table (a file or a folder of files) as a stream in event time; later rows than ``late`` behind the newest are dropped."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def appended(stream: DataFrame, name: str) -> DataFrame:
    """Rows of a stream in append mode, once all files are read."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def updated(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The last row of each key of a stream in update mode. A batch that is written again replaces its own file, so the result is the same."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows").drop("batch")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n", "_batch")


def tumbling(stream: DataFrame, size: str) -> DataFrame:
    return stream.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(stream: DataFrame, size: str, step: str) -> DataFrame:
    return stream.groupBy(F.window("at", size, step).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("highest")).select(F.col("w.start").alias("start"), "n", "highest")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    """Visits of each user: events less than ``gap`` apart."""
    return stream.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
