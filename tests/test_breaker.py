"""Breakers against a plain loop, and fallbacks."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import breaker


def slow(rows, limit, cold):
    """The loop that makes the attempts: rows are (key, n, ok) in their order."""
    streak, won, made = {}, set(), {}
    closed = set()
    for key, n, ok in rows:
        if key in closed or (streak.get(key, 0) >= limit and not (cold and key in won)):
            closed.add(key)
            made[n] = False
            continue
        made[n] = True
        streak[key] = 0 if ok else streak.get(key, 0) + 1
        won |= {key} if ok else set()
    return made


@pytest.mark.parametrize("cold", [True, False])
@pytest.mark.parametrize("block", [1, 7, 1000])
def test_against_the_loop(spark, cold, block):
    rng = random.Random(block)
    share = {"hot": 0.35, "a": 0.3, "b": 0.05, None: 0.4, "never": 0.0}
    rows = [(k, n, rng.random() < share[k] or None if k == "b" else rng.random() < share[k]) for n in range(600) for k in [rng.choice(["hot", "hot", "hot", *share])]]
    df = spark.createDataFrame(rows, "key string, n int, ok boolean").repartition(5)
    got = breaker.tripped(df, "key", ["n"], ~F.col("ok"), F.floor(F.col("n") / block), 4, cold)
    assert {r.n: r.made for r in got.collect()} == slow([(k, n, bool(ok)) for k, n, ok in rows], 4, cold)
    assert breaker.tripped(df.limit(0), "key", ["n"], ~F.col("ok"), F.lit(0)).collect() == []


def test_pages_before_feeds(spark):
    log = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False), ("a", True)], "token string, made boolean")
    pages = spark.createDataFrame([("a", 3), ("b", 0), ("c", None), ("d", 1)], "token string, n int")
    feeds = spark.createDataFrame([("a", 9), ("b", 2), ("c", 0)], "token string, n int")
    assert {r.token: r.way for r in breaker.covered(log, pages, feeds, "token", F.col("n")).collect()} == {"a": "page", "b": "feed", "c": "none"}


def test_first_usable(spark):
    rows = [("x", 1, "slow", 5), ("x", 2, "fast", 0), ("x", 3, "fast", 7), ("x", 4, "fast", 9), ("y", 5, "fast", None), (None, 6, "slow", 1)]
    df = spark.createDataFrame(rows, "key string, n int, source string, got int")
    rank = F.when(F.col("source") == "fast", 0).otherwise(1)
    assert {r.key: r.n for r in breaker.first_usable(df, ["key"], rank, F.col("got") > 0, ["n"]).collect()} == {"x": 3, None: 6}
