"""Snapshots on disk: reading the first that there is, and publishing a full and a short form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLIENT_CHARS = 1200  # fixed value


def read_first(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first snapshot that can be read and has rows; else an empty one."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            found = spark.read.schema(schema).parquet(path)
            if found.limit(1).collect():
                return found
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)


def client_projection(listings: DataFrame, chars: int = CLIENT_CHARS) -> DataFrame:
    """Short descriptions, no HTML."""
    return listings.withColumns({"description": F.substring("description", 1, chars), "descriptionHtml": F.lit(None).cast("string")})


def publish(listings: DataFrame, path: str, run: str) -> None:
    """Writes <path>/run=<run>/full and /client; a snapshot is a folder of its own, so readers never see half of one."""
    listings.write.mode("overwrite").parquet(f"{path}/run={run}/full")
    client_projection(listings).write.mode("overwrite").json(f"{path}/run={run}/client")


def sitemap(listings: DataFrame, base: str, limit: int = 5000) -> DataFrame:
    """url and last change of the first open listings; a sitemap holds that many."""
    return listings.where(~F.col("isExpired")).orderBy("_ord").limit(limit).select(F.concat(F.lit(base), F.col("id")).alias("url"), "lastSeenAt")


def source_status(spark: SparkSession, sources: list, enabled: list) -> DataFrame:
    on = {s.id for s in enabled}
    return spark.createDataFrame([(i, s.id, s.name, s.id in on, None if s.id in on else "not selected") for i, s in enumerate(sources)], "place int, id string, name string, enabled boolean, reason string")
