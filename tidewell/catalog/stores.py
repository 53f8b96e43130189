"""Queries over stores: tables are written into a store in the shared folder, changed there, and read back."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewell.operators import breaker
from tidewell.scratch import new_folder
from tidewell.sources import store

from . import query
from .relational import _C, _CUT, _P, _TS, MERGED, _current, _previous

c = F.col


def _store(t, label):
    spark = t("region").sparkSession
    return store.Store(spark, new_folder(spark, label))


def _filled(t, label):
    """A store with one version of listings."""
    made = _store(t, label)
    made.commit(made.manifest(), {"listings": store.by_day(_previous(t))}, by={"listings": [store.SEEN_DAY]})
    return made


@query(f"SELECT p.id, p.e OR coalesce(p.l < {_CUT}, false) AS is_expired, CAST(count(*) FILTER (NOT p.e AND coalesce(p.l < {_CUT}, false)) OVER () AS BIGINT) AS n_expired FROM {_P} p")
def store_expire(t):
    s = _filled(t, "store-expire")
    at, n = store.expire_stored(s, datetime(2024, 5, 20))
    return s.read("listings", at).select("id", c("isExpired").alias("is_expired"), F.lit(n).cast("long").alias("n_expired"))


@query(f"SELECT id, CAST((SELECT count(*) FROM documents) - count(*) OVER () AS BIGINT) AS n_purged FROM {_P} WHERE coalesce(epoch_us(l) >= epoch_us({_TS}) - 10 * 86400000000, true)")
def store_purge(t):
    s = _filled(t, "store-purge")
    at, n = store.purge_stored(s, MERGED, 10)
    return s.read("listings", at).select("id", F.lit(n).cast("long").alias("n_purged"))


_AGE = f"coalesce((epoch_us({_TS}) - epoch_us(l)) / 86400000000.0, 1e9)"


@query(f"""
WITH p AS (SELECT * FROM {_P} p WHERE true), n AS (SELECT * FROM {_C} c),
known AS (SELECT id FROM p)
SELECT 'first' AS run, CAST(60000 AS BIGINT) AS duration_ms, count(*) AS fetched, count(*) AS kept, count(*) AS inserted,
  CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS expired, count(*) AS stored FROM p
UNION ALL
SELECT 'second', CAST(60000 AS BIGINT), (SELECT count(*) FROM n), (SELECT count(*) FROM n),
  (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM known)), (SELECT count(*) FROM n WHERE id IN (SELECT id FROM known)),
  (SELECT count(*) FROM p WHERE id NOT IN (SELECT id FROM n) AND NOT e),
  (SELECT count(*) FROM n) + (SELECT count(*) FROM p WHERE id NOT IN (SELECT id FROM n))
""")
def store_runs(t):
    """Two runs, four days apart: what each of them took in, and how many listings each version has."""
    s = _store(t, "store-runs")
    minute = timedelta(minutes=1)
    stored = []
    for run, rows, at in (("first", _previous(t), MERGED), ("second", _current(t), MERGED + timedelta(days=4))):
        made = store.ingest(s, rows, run, at - minute, at, rows.count())
        stored.append((run, s.read("listings", made).count()))
    counts = t("region").sparkSession.createDataFrame(stored, "run string, stored long")
    return s.read("runs").join(F.broadcast(counts), "run").select("run", "duration_ms", "fetched", "kept", "inserted", "updated", "expired", "stored")


# ---- breakers and fallbacks over events ----

_FAILED = "event_type IN ('error', 'view')"
_STREAKS = f"""
placed AS (SELECT *, row_number() OVER w AS n, {_FAILED} AS failed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
last AS (SELECT *, max(CASE WHEN NOT failed THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS success FROM placed),
streaks AS (SELECT *, n - 1 - coalesce(success, 0) AS streak FROM last)"""


def _attempts(t):
    return t("events").select("user_id", "ts", "event_id", "event_type", "value")


def _tripped(t, limit, cold):
    failed, day = c("event_type").isin("error", "view"), F.to_date("ts")
    return breaker.tripped(_attempts(t), "user_id", ["ts", "event_id"], failed, day, limit, cold)


def _sql_tripped(limit, cold):
    test = f"streak >= {limit}" + (" AND success IS NULL" if cold else "")
    return f"""WITH {_STREAKS}, opened AS (SELECT user_id, min(n) AS opens FROM streaks WHERE {test} GROUP BY user_id)
SELECT event_id, opens IS NULL OR n < opens AS made FROM streaks LEFT JOIN opened USING (user_id)"""


@query(_sql_tripped(6, False))
def breaker_streak(t):
    return _tripped(t, 6, False).select("event_id", "made")


@query(_sql_tripped(2, True))
def breaker_cold(t):
    return _tripped(t, 2, True).select("event_id", "made")


@query("""
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, ts, event_id) AS place
  FROM events WHERE value >= 40) WHERE place = 1
""")
def first_usable_source(t):
    rank = F.when(c("event_type") == "purchase", 0).when(c("event_type") == "signup", 1).otherwise(2)
    return breaker.first_usable(_attempts(t), ["user_id"], rank, c("value") >= 40, ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")
