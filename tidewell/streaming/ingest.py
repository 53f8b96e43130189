"""Incremental ingestion with Structured Streaming: landed raw listings become snapshots, one merge for each batch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.merge import kept, merge_snapshots
from tidewell.schema import RAW


def raw_stream(spark: SparkSession, landing: str) -> DataFrame:
    """Raw listings as they land, as Parquet files."""
    return spark.readStream.schema(RAW).parquet(landing)


def first_seen_stream(stream: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """One row for each source and job id within the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["sourceId", "sourceJobId"])


def daily_counts(stream: DataFrame, event_time: str, delay: str = "21 days") -> DataFrame:
    """Postings of each UTC day; late ones count until the watermark passes."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "n")


def merge_stream(listings: DataFrame, store: str, checkpoint: str, schema: str, clock=datetime.utcnow, retention: int = 21, stale: int = 3) -> StreamingQuery:
    """Merges every batch of listings into the snapshot before it. Snapshots are folders named by batch, so a batch that runs again writes the same one.

    An empty snapshot counts as one; where the one before is missing, reading it fails rather than starting afresh.
    """

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(schema).parquet(f"{store}/batch={n - 1}") if n else spark.createDataFrame([], schema)
        merged = kept(merge_snapshots(before, batch, clock(), retention, stale))
        merged.drop("merge_side", "merge_status").write.mode("overwrite").parquet(f"{store}/batch={n}")

    return listings.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
