"""Daily bars from a stream of events, merged into a stored table batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.storage import shared_root

KEYS = ("ticker", "date")


def bars(events: DataFrame) -> DataFrame:
    """Partial bars: they can be merged again by the same aggregates."""
    return events.groupBy((F.col("user_id") % 20).cast("long").alias("ticker"), F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("high"), F.min("value").alias("low"), F.sum("value").alias("volume")
    )


def merge(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))


def upsert(stored: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows of both; where both have a key the fresh row wins, but a fresh NULL keeps the stored value."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.select(*stored.columns).withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(F.col("_new"))
    whole = latest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    values = [F.last(c, ignorenulls=True).over(whole).alias(c) for c in stored.columns if c not in keys]
    return both.select(*keys, *values, F.row_number().over(latest).alias("_no")).filter("_no = 1").drop("_no")


def stream_daily_bars(spark: SparkSession, source: str, pattern: str, folder: str) -> DataFrame:
    """Run an event file stream to its end; each micro-batch appends its partial bars under its own number.

    A batch that is run again overwrites its own part, so a restart neither loses nor doubles anything.
    """
    schema = spark.read.parquet(f"{source}/{pattern}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        bars(batch).write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return merge(spark.read.parquet(f"{folder}/parts"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream_daily_bars(spark, sf_dir, "events.parquet", f"{shared_root(spark)}/stream-{uuid.uuid4().hex}")
    return out.select("ticker", "date", "n", F.round("high", 6).alias("high"), F.round("low", 6).alias("low"), F.round("volume", 4).alias("volume"))
