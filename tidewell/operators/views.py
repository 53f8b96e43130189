"""Projections of listings for lists and single pages, and a store's state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.dates import relative_time
from tidewell.functions.salary import format_salary
from tidewell.operators.filters import city_label
from tidewell.schema import ARRANGEMENTS


def labelled(x: Column, labels: dict[str, str]) -> Column:
    names = F.create_map(*(F.lit(v) for kv in labels.items() for v in kv))
    return F.coalesce(F.try_element_at(names, x), x)


def card(listings: DataFrame, now: datetime, technologies: int = 6, certifications: int = 4) -> DataFrame:
    """What a list shows: the first tags, a place, pay and age as text (counts are fixed values)."""
    c = F.col
    place = F.coalesce(F.nullif(c("locationRaw"), F.lit("")), city_label(c("city"), c("workArrangement") == "remote"))
    return listings.select(
        "id", "title", "company", place.alias("place"), labelled(c("workArrangement"), ARRANGEMENTS).alias("arrangement"), format_salary(c("salary")).alias("pay"), relative_time(c("postedAt"), now).alias("age"),
        F.slice("requirements.technologies", 1, technologies).alias("technologies"), F.slice("requirements.certifications", 1, certifications).alias("certifications"), "summary", "isExpired", "isRepost", "_ord",
    )


def detail(listings: DataFrame, ident: str, now: datetime) -> DataFrame:
    """All fields of one listing, with pay, age and labels as text."""
    c = F.col
    return listings.where(c("id") == ident).withColumns({"pay": format_salary(c("salary")), "age": relative_time(c("postedAt"), now), "arrangement": labelled(c("workArrangement"), ARRANGEMENTS)})


def health(listings: DataFrame) -> DataFrame:
    """One row: how many listings there are, open ones, and when the last was seen."""
    return listings.agg(F.count(F.lit(1)).alias("listings"), F.count_if(~F.col("isExpired")).alias("open"), F.max("lastSeenAt").alias("last_seen"))
