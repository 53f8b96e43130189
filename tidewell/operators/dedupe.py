"""Duplicates: grouping by fingerprint, electing a winner, uniting what the others know, and reposts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values ----
SOURCE_PRIORITY = {"greenhouse": 100, "lever": 98, "ashby": 97, "workable": 92, "recruitee": 90, "smartrecruiters": 88, "jobbank": 80, "adzuna": 60, "jooble": 55, "arbeitnow": 40, "remotive": 40, "jobicy": 35}
OTHER_PRIORITY = 50
UNION_CAPS = {"requiredSkills": 30, "preferredSkills": 25, "technologies": 40, "certifications": 20, "education": 5}
REPOST_DAYS = 21


def source_priority(source: Column, table: dict[str, int] | None = None, other: int = OTHER_PRIORITY) -> Column:
    names = F.create_map(*(F.lit(x) for kv in (SOURCE_PRIORITY if table is None else table).items() for x in kv))
    return F.coalesce(F.try_element_at(names, source), F.lit(other))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a given order (dropDuplicates has none): a partial aggregate, so a task sends one row a key."""
    best = F.min_by(F.struct(*(F.col(f"`{x}`") for x in rows.columns)), F.struct(*order)).alias("_first")
    return rows.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys))).agg(best).select("_first.*")


def elected(rows: DataFrame, group: str, priority: Column, length: Column, posted: Column, order: str) -> DataFrame:
    """The winner of each group: priority, then length, then date, all descending (nulls last), then the input order; one row a group and task is shuffled."""
    epoch = F.coalesce(F.unix_micros(posted.cast("timestamp")), F.lit(0))
    low = lambda x: F.struct(x.isNull().alias("none"), (-x).alias("value"))
    keys = F.struct(low(priority).alias("priority"), low(length).alias("length"), (-epoch).alias("epoch"), F.col(order).alias("order"))
    return rows.groupBy(F.col(group).alias("_group")).agg(F.min_by(F.struct(*rows.columns), keys).alias("_winner")).select("_winner.*")


def first_of_group(rows: DataFrame, group: str, order: str, item: Column, most: int) -> DataFrame:
    """The group, and `items` of its first `most` rows. The limit is applied within tasks before rows are shuffled, so a hot group sends `most` rows a task."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    first = rows.select(group, order, item.alias("_item")).withColumn("_place", place).where(F.col("_place") <= most)
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_item"))), lambda s: s["_item"]).alias("items"))


def united_lists(rows: DataFrame, group: str, order: str, lists: dict[str, tuple[Column, int]]) -> DataFrame:
    """A row for each group with the lists' distinct items, in the rows' order and then the items' own, each list cut to its number.

    Only the first place of each distinct item is kept before a group's items meet, so a group of any number of rows fits.
    """
    kind = "array<struct<list:string,pos:int,item:string>>"
    entries = [_entries(name, items, kind) for name, (items, _) in lists.items()]
    every = rows.select(F.col(group), F.col(order).alias("_o"), F.explode(F.concat(*entries)).alias("_e")).select(group, "_o", "_e.*")
    firsts = every.groupBy(group, "list", "item").agg(F.min(F.struct("_o", "pos")).alias("at"))
    own = lambda name, cap: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("at", "item")))), lambda s: s["item"]), 1, cap)
    return firsts.groupBy(group).agg(*(own(name, cap).alias(name) for name, (_, cap) in lists.items()))


def _entries(name: str, items: Column, kind: str) -> Column:
    made = F.transform(items, lambda x, i: F.struct(F.lit(name).alias("list"), i.alias("pos"), x.alias("item")))
    return F.coalesce(made.cast(kind), F.array().cast(kind))


def dedupe(listings: DataFrame) -> DataFrame:
    """One listing for each fingerprint: the winner's fields, the earliest date, pay from whoever has it, united lists, where else it was posted.

    Only the keys of an election and what alsoPostedOn names of a copy meet in a group; the winner's row is joined by (fingerprint, _ord).
    """
    posted = F.coalesce(F.unix_micros(F.col("postedAt").cast("timestamp")), F.lit(0))
    # a null length comes last, as it does in a descending order
    keys = [-source_priority(F.col("sourceId")), -F.coalesce(F.length("description"), F.lit(-1)), -posted, F.col("_ord")]
    url = F.when(F.coalesce(F.col("applyUrl"), F.lit("")) != "", F.col("applyUrl")).otherwise(F.col("sourceUrl"))
    copy = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.col("sourceName").alias("sourceName"), url.alias("url"))
    group = listings.groupBy("fingerprint").agg(
        F.min("postedAt").alias("_earliest"),
        F.min_by(F.col("salary"), F.when(F.col("salary.min").isNotNull(), F.col("_ord"))).alias("_pay"),
        F.max("relevanceScore").alias("_relevance"),
        F.count(F.lit(1)).cast("int").alias("_copies"),
        F.sort_array(F.collect_list(copy)).alias("_ranked"),
    )
    named = F.transform(F.slice("_ranked", 2, F.size("_ranked")), lambda s: F.struct(s["sourceName"].alias("sourceName"), s["url"].alias("url")))
    group = group.withColumn("_winner", F.col("_ranked")[0][f"k{len(keys) - 1}"]).withColumn("_others", named).drop("_ranked")
    wanted = united_lists(listings, "fingerprint", "_ord", {f"_{k}": (F.col("requirements")[k], cap) for k, cap in UNION_CAPS.items()})
    found = group.join(wanted, "fingerprint", "left").withColumnsRenamed({"fingerprint": "_group"})
    out = listings.join(found, F.col("fingerprint").eqNullSafe(F.col("_group")) & (F.col("_ord") == F.col("_winner")))
    none = F.array().cast("array<string>")
    lists = F.col("requirements")
    for k in UNION_CAPS:
        lists = lists.withField(k, F.coalesce(F.col(f"_{k}"), none))
    # the rank score, expiry and years stay as they were computed for the winner
    out = out.withColumns({
        "postedAt": F.coalesce("_earliest", "postedAt"), "salary": F.when(F.col("salary.min").isNull(), F.coalesce("_pay", "salary")).otherwise(F.col("salary")), "requirements": lists,
        "relevanceScore": F.col("_relevance"), "duplicateCount": F.col("_copies"), "alsoPostedOn": F.col("_others"),
    })
    return out.select(*listings.columns)


def merged_count(rows: DataFrame, key: str) -> DataFrame:
    """How many rows were merged away."""
    return rows.groupBy(key).count().agg(F.sum(F.col("count") - 1).cast("long").alias("merged"))


def mark_reposts(current: DataFrame, existing: DataFrame, key: str, ident: str, posted: str, order: str, days: int = REPOST_DAYS) -> DataFrame:
    """Adds is_repost and repost_of: the last existing row with the same key has another id and is more than `days` days apart."""
    last = existing.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(F.col(ident).alias("id"), F.col(posted).alias("at")), F.col(order)).alias("_last"))
    gap = F.unix_micros(F.col(posted).cast("timestamp")) - F.unix_micros(F.col("_last.at").cast("timestamp"))
    again = F.coalesce((F.col("_last.id") != F.col(ident)) & (gap > days * 86_400_000_000), F.lit(False))
    return current.join(last, F.col(key) == F.col("_key"), "left").withColumn("is_repost", again).withColumn("repost_of", F.when(again, F.col("_last.id"))).drop("_key", "_last")
