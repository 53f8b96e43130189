"""Facets and dashboard aggregates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.filters import city_label


#: Slices of a facet's values, by hash, that are cut to the limit before they are ranked together.
SLICES = 64


@dataclass(frozen=True)
class Facet:
    """name, the values of a row (an array column), how many to keep, labels of values."""

    name: str
    values: Column
    limit: int
    labels: dict[str, str] | None = None


def listing_facets() -> list[Facet]:
    """The nine facets of listings with their limits (fixed values); of a row's technologies the first twelve count."""
    c, one = F.col, lambda x: F.array(x)
    return [
        Facet("categories", one(c("category")), 40), Facet("experience", one(c("experienceLevel")), 12), Facet("arrangement", one(c("workArrangement")), 6), Facet("employment", one(c("employmentType")), 8),
        Facet("cities", one(city_label(c("city"), c("workArrangement") == "remote")), 60), Facet("companies", one(c("company")), 60), Facet("sources", one(c("sourceName")), 20),
        Facet("certifications", c("requirements.certifications"), 30), Facet("skills", F.slice(c("requirements.technologies"), 1, 12), 40),
    ]


def facet_counts(rows: DataFrame, facets: list[Facet]) -> DataFrame:
    """facet, value, label, n, rank of all facets in one pass: rows are exploded to (facet, value), counted before the shuffle, and ranked within facets."""
    pairs = F.flatten(F.array(*map(_pairs, facets)))
    counted = rows.select(F.explode(pairs).alias("p")).select("p.*").where(F.coalesce(F.col("value"), F.lit("")) != "").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    # a facet can have any number of values: each of its slices keeps its first ones, and what they keep is ranked
    order = [F.desc("n"), F.collate("value", "UNICODE"), "value"]
    slices = counted.withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(SLICES)))
    kept = slices.withColumn("place", F.row_number().over(Window.partitionBy("facet", "slice").orderBy(*order))).where(F.col("place") <= max(f.limit for f in facets)).drop("slice", "place")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("facet").orderBy(*order)))
    limits = F.create_map(*(F.lit(x) for f in facets for x in (f.name, f.limit)))
    label = F.col("value")
    for f in facets:
        if f.labels:
            names = F.create_map(*(F.lit(x) for kv in f.labels.items() for x in kv))
            label = F.when(F.col("facet") == f.name, F.coalesce(F.try_element_at(names, F.col("value")), F.col("value"))).otherwise(label)
    return ranked.where(F.col("rank") <= F.element_at(limits, F.col("facet"))).select("facet", "value", label.alias("label"), "n", "rank")


def _pairs(f: Facet) -> Column:
    return F.coalesce(F.transform(f.values.cast("array<string>"), lambda v: F.struct(F.lit(f.name).alias("facet"), v.alias("value"))), F.array().cast("array<struct<facet:string,value:string>>"))


def ordered_levels(counts: DataFrame, levels: list[str], selected: list[str] = ()) -> DataFrame:
    """level, n, place in a fixed order; levels with rows, or selected, are shown. counts: value, n."""
    spark = counts.sparkSession
    dim = spark.createDataFrame([(x, i, x in selected) for i, x in enumerate(levels)], "level string, place int, selected boolean")
    return F.broadcast(dim).join(counts, F.col("level") == F.col("value"), "left").select("level", F.coalesce("n", F.lit(0)).alias("n"), "place", "selected").where("n > 0 or selected").select("level", "n", "place")


def count_by(rows: DataFrame, value: Column, order: Column, limit: int | None = None) -> DataFrame:
    """value, n: most frequent first, ties by first appearance; nulls count as a value."""
    out = rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen")
    return out.limit(limit) if limit else out


def dashboard_lists() -> list[Facet]:
    """The dashboard's eight lists with their limits (fixed values; 0 is none)."""
    c, one = F.col, lambda x: F.array(x)
    remote = c("workArrangement") == "remote"
    return [
        Facet("category", one(c("category")), 12),
        Facet("experience", one(c("experienceLevel")), 0),
        Facet("region", one(city_label(c("region"), remote, "Unspecified", "Remote (Canada)")), 0),
        Facet("city", one(city_label(c("city"), remote, "Unspecified")), 12),
        Facet("certifications", c("requirements.certifications"), 15),
        Facet("technologies", c("requirements.technologies"), 15),
        Facet("employers", one(c("company")), 15),
        Facet("source", one(c("sourceId")), 0),
    ]


def top_lists(rows: DataFrame, lists: list[Facet], order: Column) -> DataFrame:
    """list, value, n, rank of all lists in one pass: most frequent first, ties by first appearance in `order` and within a row's array.

    Values are counted before the shuffle. Lists with a limit are ranked slice by slice first, so that no list's values all meet in one task;
    those without one (limit 0) are of columns with few values.
    """
    kind = "array<struct<list:string,pos:int,value:string>>"
    entry = lambda f: F.transform(f.values.cast("array<string>"), lambda v, i: F.struct(F.lit(f.name).alias("list"), i.alias("pos"), v.alias("value")))
    pairs = F.flatten(F.array(*(F.coalesce(entry(f).cast(kind), F.array().cast(kind)) for f in lists)))
    counted = rows.select(order.alias("_o"), F.explode(pairs).alias("_e")).select("_o", "_e.*")
    counted = counted.groupBy("list", "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_o", "pos")).alias("at"))
    limits = F.create_map(*(F.lit(x) for f in lists for x in (f.name, f.limit or 2**31 - 1)))
    named = [f.name for f in lists if f.limit]
    keys = [F.desc("n"), "at"]
    sliced = counted.where(F.col("list").isin(named)).withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(SLICES)))
    top = Window.partitionBy("list", "slice").orderBy(*keys)
    kept = sliced.withColumn("place", F.row_number().over(top)).where(F.col("place") <= max(f.limit for f in lists)).drop("slice", "place")
    both = kept.unionByName(counted.where(~F.col("list").isin(named)))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(*keys)))
    return ranked.where(F.col("rank") <= F.element_at(limits, F.col("list"))).select("list", "value", "n", "rank")


def kpis(rows: DataFrame, live: Column, age_days: Column, company: Column, remote: Column, hybrid: Column, entry: Column, pathway: Column) -> DataFrame:
    """The eight headline numbers in one aggregate."""
    n = lambda c: F.count_if(live & c)
    return rows.agg(
        F.count_if(live).alias("live"), F.count_if(~live).alias("expired"), n(F.coalesce(age_days <= 1, F.lit(False))).alias("today"), n(F.coalesce(age_days <= 7, F.lit(False))).alias("week"), F.count_distinct(F.when(live, company)).alias("companies"),
        n(remote).alias("remote"), n(hybrid).alias("hybrid"), n(entry).alias("entry_friendly"), n(pathway).alias("pathway"),
    )


def upper_median(rows: DataFrame, value: Column, low: float = 20_000, high: float = 1_000_000) -> DataFrame:
    """The element at place floor(n / 2) of the sorted values between the bounds (fixed values).

    Values are counted first, so the running sum has a row for each distinct value, and those are summed by ranges before the last range is looked into.
    """
    kept = rows.select(value.cast("double").alias("v")).where((F.col("v") > low) & (F.col("v") < high)).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    cell = F.floor((F.col("v") - low) / ((high - low) / 4096)).cast("int")
    cells = kept.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"))
    w = Window.orderBy("cell")  # 4096 rows at most
    spots = cells.select("cell", F.sum("n").over(w).alias("upto"), "n", F.sum("n").over(Window.partitionBy()).alias("every"))
    half = F.floor(F.col("every") / 2)
    spot = spots.where((F.col("upto") > half) & (F.col("upto") - F.col("n") <= half)).select("cell", (half - (F.col("upto") - F.col("n"))).alias("left"))
    inside = kept.withColumn("cell", cell).join(F.broadcast(spot), "cell")  # one row
    run = F.sum("n").over(Window.partitionBy("cell").orderBy("v"))
    return inside.withColumn("run", run).where("run > left").agg(F.min("v").alias("median"))


def trend(rows: DataFrame, day: Column, today: date, days: int = 30) -> DataFrame:
    """day, n for each of the last `days` days, zeros included."""
    first = F.date_sub(F.lit(today), days - 1)
    frame = rows.sparkSession.range(1).select(F.explode(F.sequence(first, F.lit(today))).alias("day"))
    counted = rows.select(day.cast("date").alias("day")).where(F.col("day").between(first, F.lit(today))).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return frame.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def bar_percent(counts: DataFrame) -> DataFrame:
    """Adds percent: the count as a rounded share of the largest."""
    most = counts.agg(F.max("n")).scalar()
    return counts.withColumn("percent", F.floor(100 * F.col("n") / F.greatest(most, F.lit(1)) + 0.5).cast("int"))
