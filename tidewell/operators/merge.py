"""Snapshots: merging a run into the last one, upserts, expiry, purging, and the gate before publishing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.dates import DAY, instant, micros

RETENTION_DAYS, STALE_DAYS, PURGE_DAYS = 21, 3, 120  # fixed values


def _age(t: Column, now: datetime) -> Column:
    """Days, infinite for null."""
    return F.coalesce((micros(instant(now)) - micros(t)) / DAY, F.lit(float("inf")))


def merge_snapshots(previous: DataFrame, current: DataFrame, now: datetime, retention: float = RETENTION_DAYS, stale: float = STALE_DAYS) -> DataFrame:
    """All rows of current and what previous still holds, with merge_status: refreshed, added, carried, newly_expired or dropped.

    Both have id, firstSeenAt, lastSeenAt, isExpired, isRepost, repostOf, _ord. The current row wins; of several current rows with an id
    only the first takes over what was known before. Rows come in the order (merge_side, _ord).

    An id's first row is found by a partial aggregate and rows are joined by (id, _ord), so no id's rows, null ids included, meet in one task.
    """
    known = previous.where(F.col("id").isNotNull())
    known = known.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct(*previous.columns), F.struct("_ord")).alias("_last")).select("_last.*")
    firsts = current.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("_first_id")).agg(F.min("_ord").alias("_first_ord"))
    c, p = current.alias("c"), known.join(firsts, F.col("id") == F.col("_first_id"), "left").alias("p")
    joined = c.join(p, (F.col("c.id") == F.col("p.id")) & (F.col("c._ord") == F.col("p._first_ord")), "full_outer")
    own, before = F.col("c.id").isNotNull() | F.col("c._ord").isNotNull(), F.col("p.id").isNotNull()
    unseen = _age(F.col("p.lastSeenAt"), now)
    status = F.when(own & before, "refreshed").when(own, "added").when(unseen > retention, "dropped").when((unseen > stale) & ~F.col("p.isExpired"), "newly_expired").otherwise("carried")
    special = {
        "firstSeenAt": F.when(own, F.coalesce("p.firstSeenAt", "c.firstSeenAt", instant(now))).otherwise(F.col("p.firstSeenAt")),
        "lastSeenAt": F.when(own, instant(now)).otherwise(F.col("p.lastSeenAt")),
        "isExpired": F.when(own, F.col("c.isExpired")).otherwise(F.col("p.isExpired") | (unseen > stale)),
        "isRepost": F.when(own, F.col("c.isRepost") | F.coalesce("p.isRepost", F.lit(False))).otherwise(F.col("p.isRepost")),
        "repostOf": F.when(own, F.coalesce("c.repostOf", "p.repostOf")).otherwise(F.col("p.repostOf")),
    }
    pick = lambda name: special.get(name, F.when(own, F.col(f"c.`{name}`")).otherwise(F.col(f"p.`{name}`"))).alias(name)
    return joined.select(*map(pick, current.columns), F.when(own, 0).otherwise(1).alias("merge_side"), status.alias("merge_status"))


def merge_counts(merged: DataFrame) -> DataFrame:
    """added, refreshed, carried (those that expire now included), newly_expired, dropped."""
    n = lambda *s: F.count_if(F.col("merge_status").isin(*s))
    return merged.agg(n("added").alias("added"), n("refreshed").alias("refreshed"), n("carried", "newly_expired").alias("carried"), n("newly_expired").alias("newly_expired"), n("dropped").alias("dropped"))


def kept(merged: DataFrame) -> DataFrame:
    return merged.where("merge_status <> 'dropped'")


def sanity_check(previous: int, merged: int) -> str | None:
    """Why a snapshot must not be published, or None."""
    if merged == 0:
        return "the merged snapshot is empty"
    if previous >= 20 and merged < previous * 0.5:
        return f"the merged snapshot has {merged} rows after {previous}: more than half are gone"
    return None


def upsert(stored: DataFrame, incoming: DataFrame, keep_reposts: bool = True) -> DataFrame:
    """Incoming rows replace stored ones by id and keep their firstSeenAt; the file store also keeps what is known of reposts, the table store doesn't."""
    s, i = stored.alias("s"), incoming.alias("i")
    new = F.col("i.id").isNotNull()
    special = {"firstSeenAt": F.coalesce("s.firstSeenAt", "i.firstSeenAt")}
    if keep_reposts:
        special |= {"isRepost": F.when(new, F.col("i.isRepost") | F.coalesce("s.isRepost", F.lit(False))).otherwise(F.col("s.isRepost")), "repostOf": F.when(new, F.coalesce("i.repostOf", "s.repostOf")).otherwise(F.col("s.repostOf"))}
    pick = lambda name: special.get(name, F.when(new, F.col(f"i.`{name}`")).otherwise(F.col(f"s.`{name}`"))).alias(name)
    return s.join(i, F.col("s.id") == F.col("i.id"), "full_outer").select(*map(pick, stored.columns))


def expire_stale(stored: DataFrame, cutoff: datetime, seen: DataFrame | None = None) -> DataFrame:
    """Marks isExpired, and newly_expired where that changes. With the ids of this run (file store): unseen rows last seen, or posted, before the cutoff. Without (table store): rows last seen before it."""
    edge = micros(instant(cutoff))
    old = F.coalesce(micros(F.col("lastSeenAt")) < edge, F.lit(False))
    rows = stored
    if seen is not None:
        old = old | F.coalesce(micros(F.col("postedAt")) < edge, F.lit(False))
        ids = seen.select(F.col("id").alias("_seen")).distinct()
        rows = stored.join(ids, F.col("id") == F.col("_seen"), "left")
        old = old & F.col("_seen").isNull()
    return rows.withColumn("newly_expired", old & ~F.col("isExpired")).withColumn("isExpired", F.col("isExpired") | old).select(*stored.columns, "newly_expired")


def purge(stored: DataFrame, now: datetime, days: int = PURGE_DAYS) -> DataFrame:
    """Rows seen within `days` days; rows without a date stay."""
    return stored.where(F.coalesce(micros(F.col("lastSeenAt")) >= micros(instant(now)) - days * DAY, F.lit(True)))


def open_listings(stored: DataFrame) -> DataFrame:
    return stored.where(~F.col("isExpired"))


def overlay(payload: DataFrame, columns: DataFrame) -> DataFrame:
    """Stored columns (id, is_expired, first_seen_at) override what the payload says."""
    c = columns.select(F.col("id").alias("_id"), "is_expired", "first_seen_at")
    return payload.join(c, F.col("id") == F.col("_id"), "left").withColumns({"isExpired": F.coalesce("is_expired", "isExpired"), "firstSeenAt": F.coalesce("first_seen_at", "firstSeenAt")}).select(*payload.columns)


def most_recent(events: DataFrame, user: list[str], key: list[str], at: Column, cap: int) -> DataFrame:
    """Each user's `cap` most recent distinct keys, with mru_rank."""
    last = events.groupBy(*user, *key).agg(F.max(F.struct(at.alias("at"))).alias("last")).select(*user, *key, F.col("last.at").alias("last_at"))
    rank = F.row_number().over(Window.partitionBy(*user).orderBy(F.desc("last_at"), *key))
    return last.withColumn("mru_rank", rank).where(F.col("mru_rank") <= cap)


def status_counts(saved: DataFrame, status: str, default: str = "saved") -> DataFrame:
    """status, n, with a row 'all'."""
    named = saved.select(F.coalesce(F.col(status), F.lit(default)).alias("status"))
    return named.rollup("status").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("status", F.lit("all")).alias("status"), "n")


def run_metrics(rows: DataFrame, source: str, reason: str, top: int = 6) -> tuple[DataFrame, DataFrame]:
    """(source, fetched, kept), (reason, n, rank): what a run took in, and why it rejected rows."""
    per = rows.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col(reason).isNull()).alias("kept"))
    why = rows.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(top)
    return per, why.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "reason")))
