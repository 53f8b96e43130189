"""Stores with a manifest: whole versions, conflicts, runs, expiry by day."""

from datetime import UTC, datetime, timedelta
from threading import Barrier, Thread

import pytest
from pyspark.sql import functions as F

from tidewell.operators import merge
from tidewell.scratch import new_folder
from tidewell.sources import store

NOW = datetime(2024, 6, 1, tzinfo=UTC)
SNAPSHOT = "id string, firstSeenAt timestamp, lastSeenAt timestamp, postedAt timestamp, isExpired boolean, isRepost boolean, repostOf string, _ord long"


@pytest.fixture
def made(spark):
    return store.Store(spark, new_folder(spark, "test-store"))


def rows(spark, ids, seen=NOW):
    return spark.createDataFrame([(str(i), seen, seen, seen, False, False, None, i) for i in ids], SNAPSHOT)


def ids(df):
    return sorted(int(r.id) for r in df.collect())


def test_versions_are_whole(spark, made):
    first = made.commit(made.manifest(), {"a": spark.range(3), "b": spark.range(1)}, meta={"x": 1})
    second = made.commit(first, {"a": spark.range(5)}, {"b": spark.range(10, 12)}, meta={"y": 2})
    assert [made.read(t, first).count() for t in "ab"] == [3, 1] and [made.read(t, second).count() for t in "ab"] == [5, 3]
    assert made.manifest() == second and made.manifest(1) == first and second.meta == {"x": 1, "y": 2}
    assert made.read("c") is None and store.Store(spark, made.path + "-none").manifest().version == 0


@pytest.mark.parametrize("way", ["link", "rename"])
def test_of_two_writers_one_wins(spark, made, way, monkeypatch):
    if way == "rename":  # as on a file system without hard links
        monkeypatch.setattr(store.Files, "_linked", store.Files._renamed)
    base, start, out = made.manifest(), Barrier(4), []

    def write(k):
        start.wait()
        try:
            out.append(("won", k, made.commit(base, {"a": spark.range(k)}).version))
        except store.Conflict:
            out.append(("lost", k, None))

    threads = [Thread(target=write, args=(k,)) for k in range(1, 5)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    won = [x for x in out if x[0] == "won"]
    assert len(out) == 4 and len(won) == 1 and won[0][2] == 1 and made.read("a").count() == won[0][1]
    assert made.versions() == [1] and not [x for x in made.files.names("manifests") if "draft" in x]


def test_vacuum_keeps_what_versions_name(spark, made):
    at = made.manifest()
    for k in range(1, 5):
        at = made.commit(at, {"a": spark.range(k)}, {"log": spark.range(1)})
    assert made.vacuum(2, datetime.now() - timedelta(days=1)) == []  # too young
    assert len(made.vacuum(2, datetime.now() + timedelta(days=1))) == 2
    assert made.versions() == [3, 4] and made.read("a", made.manifest(3)).count() == 3 and made.read("log").count() == 4


def test_runs_merge_and_are_repeatable(spark, made):
    with pytest.raises(store.Refused):
        store.ingest(made, rows(spark, []), "none", NOW, NOW, 0)
    a = store.ingest(made, rows(spark, range(30)), "a", NOW, NOW, 40)
    assert store.ingest(made, rows(spark, range(30)), "a", NOW, NOW, 40) == a
    later = NOW + timedelta(days=5)
    store.ingest(made, rows(spark, range(20, 40), later), "b", later - timedelta(seconds=2), later, 20)
    assert ids(made.read("listings")) == list(range(40)) and made.read("listings").where("isExpired").count() == 20
    assert store.health(made) == {"version": 3, "job_count": 40, "last_ingest_at": later.isoformat(), "last_run": "b", "runs": 3, "refused": 1}
    b = made.read("runs").where("run = 'b'").first()
    assert (b.duration_ms, b.fetched, b.kept, b.inserted, b.updated, b.expired) == (2000, 20, 20, 10, 10, 20)
    much_later = NOW + timedelta(days=300)
    with pytest.raises(store.Refused):  # a listing after 40
        store.ingest(made, rows(spark, [1], much_later), "c", much_later, much_later, 1)
    assert made.read("listings").count() == 40 and store.health(made)["refused"] == 2


def test_a_run_that_loses_merges_again(spark, made, monkeypatch):
    store.ingest(made, rows(spark, range(5)), "a", NOW, NOW, 5)
    commit, other = store.Store.commit, []

    def late(self, base, *args, **more):
        if not other:
            other.append(1)
            store.ingest(made, rows(spark, range(3, 9)), "other", NOW, NOW, 6)
        return commit(self, base, *args, **more)

    monkeypatch.setattr(store.Store, "commit", late)
    store.ingest(made, rows(spark, range(8, 12)), "mine", NOW, NOW, 4)
    assert ids(made.read("listings")) == list(range(12)) and made.read("runs").count() == 3


def test_expiry_and_purging_touch_old_days_only(spark, made):
    listings = spark.range(400).select(
        F.col("id").cast("string").alias("id"), F.lit(NOW).alias("firstSeenAt"), F.when(F.col("id") % 9 != 0, F.timestamp_micros(F.unix_micros(F.lit(NOW)) - F.col("id") * 6 * 3_600_000_000)).alias("lastSeenAt"),
        F.lit(None).cast("timestamp").alias("postedAt"), (F.col("id") % 7 == 0).alias("isExpired"), F.lit(False).alias("isRepost"), F.lit(None).cast("string").alias("repostOf"), F.col("id").alias("_ord"))
    base = made.commit(made.manifest(), {"listings": store.by_day(listings)}, by={"listings": [store.SEEN_DAY]})
    cutoff = NOW - timedelta(days=40, hours=3)
    at, n = store.expire_stored(made, cutoff)
    want = {r.id: (r.isExpired, r.newly_expired) for r in merge.expire_stale(listings, cutoff.replace(tzinfo=None)).collect()}
    assert {r.id: r.isExpired for r in made.read("listings", at).collect()} == {k: v[0] for k, v in want.items()} and n == sum(v[1] for v in want.values())
    kept_folders = set(base.tables["listings"]["folders"]) & set(at.tables["listings"]["folders"])
    assert len(kept_folders) == sum(x.rpartition("=")[2] > "2024-04-21" for x in base.tables["listings"]["folders"])  # later days, and rows without a day
    assert store.expire_stored(made, cutoff) == (at, 0)
    now = NOW + timedelta(hours=5)
    after, gone = store.purge_stored(made, now, 60)
    assert ids(made.read("listings", after)) == ids(merge.purge(listings, now.replace(tzinfo=None), 60)) and gone == 400 - made.read("listings", after).count()
    assert made.read("listings", at).count() == 400  # who reads the version before still has it
    plan = made.read("listings").where(F.col(store.SEEN_DAY) < F.lit("2024-04-01").cast("date"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(seen_day" in plan
