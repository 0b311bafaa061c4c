"""Incremental ingest and event-time windows with Structured Streaming."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def read_files(spark: SparkSession, path: str, like: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet files under path, with the schema of the batch table `like`."""
    reader = spark.readStream.schema(spark.read.parquet(like).schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def daily_counts(stream: DataFrame, ts: str, late: str = "2 days") -> DataFrame:
    """(day, n) per event-time day, final once the watermark has passed."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")


def failure_windows(stream: DataFrame, ts: str, failed: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, n, n_failed) per tumbling window."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", width)).agg(F.count("*").alias("n"), F.count_if(F.expr(failed)).alias("n_failed")).select("window.start", "n", "n_failed")


def dedupe(stream: DataFrame, key: str, ts: str, late: str = "2 days") -> DataFrame:
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([key]).drop("_ts")


def to_the_end(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all there is and gives what its batches put out, with the number of each batch: an updated row is there once for each update. A batch that is repeated writes the same folder again."""
    spark = stream.sparkSession
    target = scratch(spark, "stream")

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/out/{number}")

    stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, _batch int").parquet(f"{target}/out/*")

