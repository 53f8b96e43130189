"""Circuit breakers and fallbacks over logs of attempts.

An attempt log has a key (a source, or a place from which it is asked), an order and an outcome. A breaker opens once LIMIT attempts in a row
have failed, in mode `cold` only while nothing has succeeded yet; what comes later isn't tried. Streaks are gaps and islands: numbered inside
blocks of the order (a day, say), with what is carried from block to block added from a table that has a row for each key and block. So a
key with a third of all attempts is spread over its blocks, and no task holds all of it.

Defined cases: a null key is a key of its own; a null outcome is a failure; equal orders are taken in an arbitrary order, so give a total one;
an empty log gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 6  # fixed value


def failure_streaks(attempts: DataFrame, key: str, order: list[str], failed: Column, block: Column) -> DataFrame:
    """Adds streak_before (failures in a row right before an attempt) and succeeded_before (whether there was any success before it).

    block ascends with the order, and its rows of one key fit a task.
    """
    rows = attempts.withColumns({"_block": block, "_failed": F.coalesce(failed, F.lit(True))})
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    n_before = F.count(F.lit(1)).over(before)
    # the place of the last success among the block's attempts so far
    place = F.row_number().over(inside)
    rows = rows.withColumns({"_n": n_before, "_place": place})
    rows = rows.withColumn("_last", F.max(F.when(~F.col("_failed"), F.col("_place"))).over(before))
    ends = rows.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_size"), F.max(F.when(~F.col("_failed"), F.col("_place"))).alias("_success"))
    # blocks in their order: a block without a success adds its attempts to the streak, one with a success starts it anew after that
    history = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_upto", F.sum("_size").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("_absolute", F.col("_upto") - F.col("_size") + F.col("_success"))
    last = F.max("_absolute").over(history)
    carried = ends.select(
        F.col(key).alias("_key"), F.col("_block").alias("_at"), (F.col("_upto") - F.col("_size") - F.coalesce(last, F.lit(0))).alias("_carried"), last.isNotNull().alias("_succeeded"))
    joined = rows.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_at")))
    streak = F.when(F.col("_last").isNotNull(), F.col("_n") - F.col("_last")).otherwise(F.col("_n") + F.col("_carried"))
    out = joined.withColumns({"streak_before": streak, "succeeded_before": F.col("_succeeded") | F.col("_last").isNotNull()})
    return out.select(*attempts.columns, "streak_before", "succeeded_before")


def tripped(attempts: DataFrame, key: str, order: list[str], failed: Column, block: Column, limit: int = LIMIT, cold: bool = True) -> DataFrame:
    """Adds made: whether the breaker of the attempt's key still let it through."""
    rows = failure_streaks(attempts, key, order, failed, block)
    opens = F.col("streak_before") >= limit
    opens = opens & ~F.col("succeeded_before") if cold else opens
    at = rows.where(opens).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order)).alias("_opened"))
    made = F.col("_opened").isNull() | (F.struct(*order) < F.col("_opened"))
    return rows.join(at, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("made", made).select(*attempts.columns, "made")


def first_usable(answers: DataFrame, key: list[str], rank: Column, usable: Column, order: list[str]) -> DataFrame:
    """For each key its first usable answer by rank and then order, as columns of answers; keys without one are left out.

    A partial aggregate keeps one answer for each key and task, so a key of any number of answers fits.
    """
    fields = [c for c in answers.columns if c not in key]
    best = F.min_by(F.struct(*fields), F.struct(rank.alias("rank"), *order)).alias("_best")
    return answers.where(F.coalesce(usable, F.lit(False))).groupBy(*key).agg(best).select(*key, "_best.*")


def covered(attempts: DataFrame, pages: DataFrame, feeds: DataFrame, token: str, rows: Column) -> DataFrame:
    """Which way each attempted token was covered: by its page if that gave rows, else by its feed. attempts: made; pages, feeds: (token, ...), one row each."""
    found = F.coalesce(rows, F.lit(0)) > 0
    page, feed = pages.where(found).select(token).distinct().withColumn("_page", F.lit(True)), feeds.where(found).select(token).distinct().withColumn("_feed", F.lit(True))
    way = F.when(F.col("_page"), "page").when(F.col("_feed"), "feed").otherwise("none")
    return attempts.where("made").select(token).distinct().join(page, token, "left").join(feed, token, "left").select(token, way.alias("way"))
