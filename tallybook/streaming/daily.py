"""Event stream -> daily totals table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def daily_totals(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Event count and total value per day, in tumbling one-day windows."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day").alias("window"))
        .agg(
            F.count("*").alias("event_count"),
            F.round(F.sum(F.col("value").cast("decimal(18,6)")), 2).cast("double").alias("total_value"),
        )
        .select(F.to_date("window.start").alias("day"), "event_count", "total_value")
    )


def start_daily_totals(
    spark: SparkSession, source: str, target: str, checkpoint: str, *, glob: str = "*.parquet"
) -> StreamingQuery:
    """Drain the files under ``source`` and keep one row per day in ``target``.

    Update mode hands over every day a batch touched, the last open one too. Each
    batch writes its own folder; ``read_daily_totals`` takes the newest per day.
    """
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{target}/batch={batch_id}"
        )

    return (
        daily_totals(events)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_daily_totals(spark: SparkSession, target: str) -> DataFrame:
    rows = spark.read.parquet(f"{target}/batch=*")
    newest = F.max_by(F.struct("event_count", "total_value"), "batch_id").alias("row")
    return rows.groupBy("day").agg(newest).select("day", "row.event_count", "row.total_value")
