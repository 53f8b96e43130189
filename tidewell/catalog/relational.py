"""Filters, search, facets, dashboards, duplicates, merges and stores over the test tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import dedupe, facets, filters, merge, search

from . import query

c = F.col
NOW = datetime(2001, 8, 2)
SQL_NOW = "TIMESTAMP '2001-08-02 00:00:00'"
PAGE = 50


def _parts(t):
    """Parts as listings: names as titles, brands as companies, types as cities, prices as pay."""
    return t("part").select(c("p_partkey").alias("id"), c("p_name").alias("title"), c("p_brand").alias("company"), c("p_type").alias("city"), c("p_retailprice").alias("pay"), c("p_size").alias("size"), F.split("p_name", " ").alias("tags"))


@query("""
WITH hits AS (SELECT p_partkey AS id, p_name AS title, p_brand AS company, p_retailprice AS pay,
  2 + (CASE WHEN contains(lower(p_name), 'red') THEN 12 ELSE 0 END) + (CASE WHEN contains(lower(p_brand), 'red') THEN 6 ELSE 0 END) + (CASE WHEN len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), 'red'))) > 0 THEN 5 ELSE 0 END) AS score, p_size
  FROM part WHERE p_retailprice >= 905 AND p_size <= 40 AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'red') AND NOT contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'gizmo')),
ranked AS (SELECT *, row_number() OVER (ORDER BY score * 3 + p_size DESC, id) AS place FROM hits)
SELECT id, title, company, pay, CAST(score AS INT) AS score, CAST(place AS BIGINT) AS place FROM ranked WHERE place <= 50
""")
def search_parts(t):
    q = search.parse_query("red -gizmo")
    rows = _parts(t).where(filters.salary_floor(c("pay"), c("pay"), 905) & (c("size") <= 40))
    hay = F.lower(F.concat_ws(" ", "title", "company", "city"))
    hits = rows.where(search.matches(q, hay)).withColumn("score", search.text_score(q, c("title"), c("company"), c("tags")).cast("int"))
    keys = search.sort_keys("relevance", c("score"), c("size"), F.lit(None).cast("timestamp"), c("pay"), c("pay"), c("company"), c("id"))
    page = hits.orderBy(*keys).limit(PAGE)
    return page.select("id", "title", "company", "pay", "score", F.row_number().over(Window.orderBy(*keys)).cast("bigint").alias("place"))


@query("SELECT doc_id, CAST(6 + 2 + 2 AS INT) AS score FROM documents WHERE contains(lower(text), 'of the') AND contains(lower(text), 'and') AND contains(lower(text), 'ing') AND NOT contains(lower(text), 'license')")
def search_phrase_exclude(t):
    q = search.parse_query('"of the" and ing -license')
    return t("documents").where(search.matches(q, F.lower("text"))).select("doc_id", search.text_score(q, F.lit("")).cast("int").alias("score"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3, 4, 5)")
def filter_in_lists(t):
    return t("customer").where(filters.in_list(c("c_mktsegment"), ["BUILDING", "MACHINERY"]) & filters.in_list(c("c_nationkey"), [1, 2, 3, 4, 5]) & filters.in_list(c("c_name"), [])).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['red', 'blue']) AS any_hit, list_has_all(string_split(lower(p_name), ' '), ['hot', 'bolt']) AS all_hit FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'blue']) OR list_has_all(string_split(lower(p_name), ' '), ['hot', 'bolt'])")
def filter_any_all_arrays(t):
    tags = F.split("p_name", " ")
    one, both = filters.any_of(tags, ["red", "blue"]), filters.all_of(tags, ["Hot", "BOLT"])
    return t("part").where(one | both).select("p_partkey", one.alias("any_hit"), both.alias("all_hit"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), CASE WHEN o_orderstatus = 'O' THEN 'Remote' ELSE 'Other' END) AS label FROM orders WHERE coalesce(nullif(o_orderpriority, '5-LOW'), CASE WHEN o_orderstatus = 'O' THEN 'Remote' ELSE 'Other' END) IN ('Remote', 'Other', '1-URGENT')")
def filter_city_fallback(t):
    label = filters.city_label(F.nullif("o_orderpriority", F.lit("5-LOW")), c("o_orderstatus") == "O")
    return t("orders").where(filters.in_list(label, ["Remote", "Other", "1-URGENT"])).select("o_orderkey", label.alias("label"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE CASE WHEN c_acctbal >= 0 THEN c_acctbal END >= 5000")
def filter_salary_floor(t):
    pay = F.when(c("c_acctbal") >= 0, c("c_acctbal"))
    return t("customer").where(filters.salary_floor(pay, F.lit(None).cast("double"), 5000)).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 0")
def filter_has_salary(t):
    return t("customer").where(F.when(c("c_acctbal") >= 0, c("c_acctbal")).isNotNull()).select("c_custkey")


@query(f"SELECT o_orderkey, o_orderdate FROM orders WHERE epoch_us({SQL_NOW}) - epoch_us(o_orderdate) <= 30 * 86400000000")
def filter_posted_within(t):
    return t("orders").where(filters.posted_within(c("o_orderdate"), 30, NOW)).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1999-03-01' AND o_orderdate <= TIMESTAMP '1999-03-11'")
def filter_posted_range(t):
    return t("orders").where(filters.posted_between(c("o_orderdate"), "1999-03-01", "1999-03-10")).select("o_orderkey", "o_orderdate")


def _top(rows, sort):
    rows = rows.withColumn("zero", F.lit(0))
    keys = search.sort_keys(sort, c("zero"), c("zero"), c("at"), c("low"), c("high"), c("company"), c("id"))
    return rows.orderBy(*keys).limit(PAGE).select("id", F.row_number().over(Window.orderBy(*keys)).cast("bigint").alias("place"))


def _orders(t):
    null = F.lit(None).cast("double")
    return t("orders").select(c("o_orderkey").alias("id"), F.when(c("o_orderstatus") != "P", c("o_orderdate")).alias("at"), F.when(c("o_orderstatus") == "O", c("o_totalprice")).alias("low"), F.when(c("o_orderpriority") == "1-URGENT", c("o_totalprice") * 2).otherwise(null).alias("high"), c("o_orderpriority").alias("company"))


_SORT = "SELECT o_orderkey AS id, CAST(place AS BIGINT) AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {}, o_orderkey) AS place FROM orders) WHERE place <= 50"
_EPOCH = "coalesce(epoch_us(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END), 0)"


@query(_SORT.format(f"{_EPOCH} DESC"))
def sort_newest(t):
    return _top(_orders(t), "newest")


@query(_SORT.format(_EPOCH))
def sort_oldest(t):
    return _top(_orders(t), "oldest")


@query(_SORT.format("coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 2 END, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END, -1) DESC"))
def sort_salary(t):
    return _top(_orders(t), "salary")


@query("SELECT s_suppkey AS id, CAST(place AS BIGINT) AS place FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_name, s_suppkey) AS place FROM supplier) WHERE place <= 50")
def sort_company(t):
    null = F.lit(None)
    return _top(t("supplier").select(c("s_suppkey").alias("id"), null.cast("timestamp").alias("at"), null.cast("double").alias("low"), null.cast("double").alias("high"), c("s_name").alias("company")), "company")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_slice(t):
    rows = t("orders")
    _, size, _, offset = search.page_bounds(rows.count(), 3, 25)
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(offset + size).offset(offset).select("o_orderkey", "o_totalprice")


@query("""
WITH pairs AS (SELECT 'type' AS facet, p_type AS value FROM part UNION ALL SELECT 'brand', p_brand FROM part UNION ALL SELECT 'size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT 'word', unnest(string_split(p_name, ' ')) FROM part),
counts AS (SELECT facet, value, count(*) AS n FROM pairs WHERE coalesce(value, '') <> '' GROUP BY facet, value),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS INT) AS rank FROM counts)
SELECT facet, value, value AS label, n, rank FROM ranked WHERE rank <= CASE facet WHEN 'type' THEN 4 WHEN 'brand' THEN 20 WHEN 'size' THEN 30 ELSE 12 END
""")
def facets_all(t):
    one = lambda x: F.array(c(x).cast("string"))
    wanted = [facets.Facet("type", one("p_type"), 4), facets.Facet("brand", one("p_brand"), 20), facets.Facet("size", one("p_size"), 30), facets.Facet("word", F.split("p_name", " "), 12)]
    return facets.facet_counts(t("part"), wanted)


@query("SELECT level, CAST(count(event_id) AS BIGINT) AS n, CAST(place AS INT) AS place FROM (VALUES ('purchase', 0), ('click', 1), ('refund', 2), ('view', 3), ('absent', 4)) v(level, place) LEFT JOIN events ON event_type = level GROUP BY level, place HAVING count(event_id) > 0 OR level = 'refund'")
def facet_levels_zero_filled(t):
    counts = t("events").groupBy(c("event_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return facets.ordered_levels(counts, ["purchase", "click", "refund", "view", "absent"], ["refund"])


@query(f"""
WITH o AS (SELECT *, o_orderstatus <> 'F' AS live, (epoch_us({SQL_NOW}) - epoch_us(o_orderdate)) / 86400000000.0 AS age FROM orders)
SELECT count(*) FILTER (live) AS live, count(*) FILTER (NOT live) AS expired, count(*) FILTER (live AND age <= 1) AS today, count(*) FILTER (live AND age <= 7) AS week, count(DISTINCT o_custkey) FILTER (live) AS companies,
count(*) FILTER (live AND o_orderpriority = '1-URGENT') AS remote, count(*) FILTER (live AND o_orderpriority = '2-HIGH') AS hybrid, count(*) FILTER (live AND o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')) AS entry_friendly, count(*) FILTER (live AND o_totalprice < 1000) AS pathway FROM o
""")
def dashboard_kpis(t):
    age = (F.lit(int((NOW - datetime(1970, 1, 1)).total_seconds()) * 1_000_000) - F.unix_micros(c("o_orderdate").cast("timestamp"))) / 86_400_000_000
    p = c("o_orderpriority")
    return facets.kpis(t("orders"), c("o_orderstatus") != "F", age, c("o_custkey"), p == "1-URGENT", p == "2-HIGH", p.isin("4-NOT SPECIFIED", "5-LOW"), c("o_totalprice") < 1000)


@query("SELECT list_sort(list(o_totalprice))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM orders WHERE o_totalprice > 20000 AND o_totalprice < 1000000")
def upper_median(t):
    return facets.upper_median(t("orders"), c("o_totalprice"))


@query("SELECT CAST(d AS DATE) AS day, count(event_id) AS n FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) g(d) LEFT JOIN events ON CAST(ts AS DATE) = CAST(d AS DATE) GROUP BY 1")
def trend_30d(t):
    return facets.trend(t("events"), c("ts"), date(2024, 1, 30))


@query("SELECT sum(n)::BIGINT AS total, max(n) AS peak FROM (SELECT count(event_id) AS n FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) g(d) LEFT JOIN events ON CAST(ts AS DATE) = CAST(d AS DATE) GROUP BY CAST(d AS DATE))")
def trend_summary(t):
    return facets.trend(t("events"), c("ts"), date(2024, 1, 30)).agg(F.sum("n").alias("total"), F.max("n").alias("peak"))


@query("SELECT value, n, first_seen FROM (SELECT n_name AS value, count(*) AS n, min(c_custkey) AS first_seen FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name) ORDER BY n DESC, first_seen LIMIT 12")
def top_n_lists(t):
    return facets.count_by(t("customer").join(t("nation"), c("n_nationkey") == c("c_nationkey")), c("n_name"), c("c_custkey"), 12)


@query("SELECT value, n, CAST(floor(100 * n / max(n) OVER () + 0.5) AS INT) AS percent FROM (SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY c_mktsegment)")
def bar_percent(t):
    return facets.bar_percent(t("customer").groupBy(c("c_mktsegment").alias("value")).agg(F.count(F.lit(1)).alias("n")))


def _gated(t):
    reason = F.when(F.length("text") < 200, "too short").when(c("lang") != "en", F.concat(F.lit("language "), c("lang"))).when(c("text").contains("$$$"), "symbols")
    return t("documents").withColumn("reason", reason)


_GATED = "(SELECT *, CASE WHEN length(text) < 200 THEN 'too short' WHEN lang <> 'en' THEN 'language ' || lang WHEN contains(text, '$$$') THEN 'symbols' END AS reason FROM documents)"


@query(f"SELECT source, count(*) AS fetched, count(*) FILTER (reason IS NULL) AS kept FROM {_GATED} GROUP BY source")
def run_metrics(t):
    return merge.run_metrics(_gated(t), "source", "reason")[0]


@query(f"SELECT reason, n, CAST(row_number() OVER (ORDER BY n DESC, reason) AS INT) AS rank FROM (SELECT reason, count(*) AS n FROM {_GATED} WHERE reason IS NOT NULL GROUP BY reason) ORDER BY n DESC, reason LIMIT 6")
def reject_reasons(t):
    return merge.run_metrics(_gated(t), "source", "reason")[1]


# ---- duplicates ----


def _copies(t):
    return t("documents").select("doc_id", "source", "lang", "n_chars", F.sha1(F.lower("text")).alias("fp"), (c("doc_id") % 97).alias("days"))


_RANKED = """(SELECT doc_id, source, lang, n_chars, sha1(lower(text)) AS fp, doc_id % 97 AS days, row_number() OVER (PARTITION BY sha1(lower(text)) ORDER BY CASE source WHEN 'src0' THEN 100 WHEN 'src1' THEN 90 WHEN 'src2' THEN 40 ELSE 50 END DESC, n_chars DESC, doc_id % 97 DESC, doc_id) AS election FROM documents)"""


@query(f"SELECT fp, doc_id, source, CAST(days AS BIGINT) AS days FROM {_RANKED} WHERE election = 1")
def dedupe_winner(t):
    priority = dedupe.source_priority(c("source"), {"src0": 100, "src1": 90, "src2": 40})
    return dedupe.elected(_copies(t), "fp", priority, c("n_chars"), F.timestamp_seconds(c("days") * 86400), "doc_id").select("fp", "doc_id", "source", "days")


@query(f"SELECT fp, CAST(count(*) AS INT) AS copies, min(days) AS earliest, array_to_string((SELECT list_distinct_ordered), ',') AS sources FROM (SELECT fp, days, doc_id, source FROM {_RANKED}) GROUP BY fp".replace("(SELECT list_distinct_ordered)", "list(source ORDER BY doc_id)[1:5]"))
def dedupe_groups(t):
    rows = _copies(t)
    sizes = rows.groupBy("fp").agg(F.count(F.lit(1)).cast("int").alias("copies"), F.min("days").alias("earliest"))
    first = dedupe.first_of_group(rows, "fp", "doc_id", c("source"), 5)
    return sizes.join(first, "fp").select("fp", "copies", "earliest", F.array_join("items", ",").alias("sources"))


@query("""
WITH w AS (SELECT sha1(lower(text)) AS fp, doc_id, source AS item, 0 AS pos FROM documents UNION ALL SELECT sha1(lower(text)), doc_id, lang, 1 FROM documents),
f AS (SELECT fp, item, min(struct_pack(doc_id := doc_id, pos := pos)) AS spot FROM w GROUP BY fp, item), r AS (SELECT fp, item, spot, row_number() OVER (PARTITION BY fp ORDER BY spot) AS k FROM f)
SELECT fp, string_agg(item, ',' ORDER BY spot) AS items FROM r WHERE k <= 4 GROUP BY fp
""")
def dedupe_union_arrays(t):
    rows = t("documents").select(F.sha1(F.lower("text")).alias("fp"), "doc_id", F.array("source", "lang").alias("items"))
    united = dedupe.united_lists(rows, "fp", "doc_id", {"all": (c("items"), 4)})
    return united.select("fp", F.array_join("all", ",").alias("items"))


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS merged FROM (SELECT count(*) AS n FROM documents GROUP BY sha1(lower(text)))")
def dedupe_stats(t):
    return dedupe.merged_count(t("documents").select(F.sha1(F.lower("text")).alias("fp")), "fp")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1")
def raw_first_wins(t):
    return dedupe.first_wins(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("""
WITH last AS (SELECT o_custkey, arg_max(struct_pack(id := o_orderkey, at := o_orderdate), o_orderkey) AS l FROM orders GROUP BY o_custkey)
SELECT o.o_orderkey, coalesce(l.id <> o.o_orderkey AND epoch_us(o.o_orderdate) - epoch_us(l.at) > 21 * 86400000000, false) AS is_repost, CASE WHEN l.id <> o.o_orderkey AND epoch_us(o.o_orderdate) - epoch_us(l.at) > 21 * 86400000000 THEN l.id END AS repost_of
FROM orders o LEFT JOIN last USING (o_custkey)
""")
def repost_flags(t):
    return dedupe.mark_reposts(t("orders"), t("orders"), "o_custkey", "o_orderkey", "o_orderdate", "o_orderkey").select("o_orderkey", "is_repost", "repost_of")


# ---- snapshots and stores ----

MERGED = datetime(2024, 6, 1)
_TS = "TIMESTAMP '2024-06-01'"


def _snapshot(t, id_step, seen, extra):
    """All documents as listings. With ids in steps, half of one snapshot's ids are in the other one."""
    at = F.lit("2024-06-01").cast("timestamp")
    ago = lambda days: F.timestamp_micros(F.unix_micros(at) - (days * 86_400_000_000).cast("bigint"))
    return t("documents").select(
        (c("doc_id") * id_step).cast("string").alias("id"), ago(c("doc_id") % 50 + extra).alias("firstSeenAt"), F.when(c("doc_id") % 41 != 0, ago(seen)).alias("lastSeenAt"), ago(c("doc_id") % 70).alias("postedAt"), (c("doc_id") % 11 == extra).alias("isExpired"), (c("doc_id") % 13 == extra).alias("isRepost"),
        F.when(c("doc_id") % 13 == extra, F.concat(F.lit("r"), c("doc_id").cast("string"))).alias("repostOf"), c("n_chars"), c("doc_id").alias("_ord"),
    )


def _previous(t):
    return _snapshot(t, 1, c("doc_id") % 30, 1)


def _current(t):
    return _snapshot(t, 2, F.lit(0).cast("bigint"), 0)


def _sql_snapshot(id_step, seen, extra):
    ago = lambda d: f"({_TS} - to_days(CAST({d} AS INT)))"
    return f"(SELECT CAST(doc_id * {id_step} AS VARCHAR) AS id, {ago(f'doc_id % 50 + {extra}')} AS f, CASE WHEN doc_id % 41 <> 0 THEN {ago(seen)} END AS l, {ago('doc_id % 70')} AS p, doc_id % 11 = {extra} AS e, doc_id % 13 = {extra} AS r, CASE WHEN doc_id % 13 = {extra} THEN 'r' || doc_id END AS ro, n_chars AS n, doc_id AS o FROM documents)"


_P, _C = _sql_snapshot(1, "doc_id % 30", 1), _sql_snapshot(2, "0", 0)
_AGE = f"coalesce((epoch_us({_TS}) - epoch_us(p.l)) / 86400000000.0, 1e9)"
_MERGED = f"""
SELECT coalesce(c.id, p.id) AS id, CASE WHEN c.id IS NOT NULL THEN coalesce(p.f, c.f) ELSE p.f END AS first_seen, CASE WHEN c.id IS NOT NULL THEN {_TS} ELSE p.l END AS last_seen, CASE WHEN c.id IS NOT NULL THEN c.e ELSE p.e OR {_AGE} > 3 END AS is_expired,
CASE WHEN c.id IS NOT NULL THEN c.r OR coalesce(p.r, false) ELSE p.r END AS is_repost, CASE WHEN c.id IS NOT NULL THEN coalesce(c.ro, p.ro) ELSE p.ro END AS repost_of,
CASE WHEN c.id IS NOT NULL AND p.id IS NOT NULL THEN 'refreshed' WHEN c.id IS NOT NULL THEN 'added' WHEN {_AGE} > 21 THEN 'dropped' WHEN {_AGE} > 3 AND NOT p.e THEN 'newly_expired' ELSE 'carried' END AS merge_status
FROM {_C} c FULL JOIN {_P} p ON c.id = p.id"""


def _ntz(rows, *names):
    return rows.withColumns({n: c(n).cast("timestamp_ntz") for n in names})


@query(_MERGED)
def merge_snapshots(t):
    m = merge.merge_snapshots(_previous(t), _current(t), MERGED)
    return m.select("id", c("firstSeenAt").cast("timestamp_ntz").alias("first_seen"), c("lastSeenAt").cast("timestamp_ntz").alias("last_seen"), c("isExpired").alias("is_expired"), c("isRepost").alias("is_repost"), c("repostOf").alias("repost_of"), "merge_status")


@query(f"SELECT count(*) FILTER (merge_status = 'added') AS added, count(*) FILTER (merge_status = 'refreshed') AS refreshed, count(*) FILTER (merge_status IN ('carried', 'newly_expired')) AS carried, count(*) FILTER (merge_status = 'newly_expired') AS newly_expired, count(*) FILTER (merge_status = 'dropped') AS dropped FROM ({_MERGED})")
def merge_counts(t):
    return merge.merge_counts(merge.merge_snapshots(_previous(t), _current(t), MERGED))


def _sql_upsert(flags):
    r = "CASE WHEN c.id IS NOT NULL THEN c.r OR coalesce(p.r, false) ELSE p.r END AS is_repost, CASE WHEN c.id IS NOT NULL THEN coalesce(c.ro, p.ro) ELSE p.ro END AS repost_of" if flags else "CASE WHEN c.id IS NOT NULL THEN c.r ELSE p.r END AS is_repost, CASE WHEN c.id IS NOT NULL THEN c.ro ELSE p.ro END AS repost_of"
    return f"SELECT coalesce(c.id, p.id) AS id, coalesce(p.f, c.f) AS first_seen, CASE WHEN c.id IS NOT NULL THEN c.l ELSE p.l END AS last_seen, {r}, CASE WHEN c.id IS NOT NULL THEN c.n ELSE p.n END AS n_chars FROM {_C} c FULL JOIN {_P} p ON c.id = p.id"


def _upserted(t, flags):
    return merge.upsert(_previous(t), _current(t), flags).select("id", c("firstSeenAt").cast("timestamp_ntz").alias("first_seen"), c("lastSeenAt").cast("timestamp_ntz").alias("last_seen"), c("isRepost").alias("is_repost"), c("repostOf").alias("repost_of"), "n_chars")


@query(_sql_upsert(True))
def upsert_file(t):
    return _upserted(t, True)


@query(_sql_upsert(False))
def upsert_table(t):
    return _upserted(t, False)


_CUT = "TIMESTAMP '2024-05-20'"


@query(f"SELECT p.id, p.e OR (NOT (p.id IN (SELECT id FROM {_C})) AND (coalesce(p.l < {_CUT}, false) OR coalesce(p.p < {_CUT}, false))) AS is_expired, NOT p.e AND NOT (p.id IN (SELECT id FROM {_C})) AND (coalesce(p.l < {_CUT}, false) OR coalesce(p.p < {_CUT}, false)) AS newly_expired FROM {_P} p")
def expire_file(t):
    return merge.expire_stale(_previous(t), datetime(2024, 5, 20), _current(t)).select("id", c("isExpired").alias("is_expired"), "newly_expired")


@query(f"SELECT p.id, p.e OR coalesce(p.l < {_CUT}, false) AS is_expired, NOT p.e AND coalesce(p.l < {_CUT}, false) AS newly_expired FROM {_P} p")
def expire_table(t):
    return merge.expire_stale(_previous(t), datetime(2024, 5, 20)).select("id", c("isExpired").alias("is_expired"), "newly_expired")


@query(f"SELECT id FROM {_P} WHERE coalesce(epoch_us(l) >= epoch_us({_TS}) - 10 * 86400000000, true)")
def purge(t):
    return merge.purge(_previous(t), MERGED, 10).select("id")


@query(f"SELECT id, n AS n_chars FROM {_P} WHERE NOT e")
def open_listings(t):
    return merge.open_listings(_previous(t)).select("id", "n_chars")


@query("SELECT user_id, event_type, last_at, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC, event_type) AS INT) AS mru_rank FROM (SELECT user_id, event_type, max(ts) AS last_at FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC, event_type) <= 3")
def recent_per_user(t):
    return merge.most_recent(t("events"), ["user_id"], ["event_type"], c("ts"), 3)


@query("SELECT coalesce(status, 'all') AS status, count(*) AS n FROM (SELECT coalesce(nullif(event_type, 'view'), 'saved') AS status FROM events) GROUP BY ROLLUP (status)")
def status_counts(t):
    return merge.status_counts(t("events").select(F.nullif("event_type", F.lit("view")).alias("s")), "s")


@query("SELECT doc_id, left(text, 1200) AS description FROM documents")
def client_projection(t):
    from tidewell.sources.snapshots import client_projection as short

    return short(t("documents").select("doc_id", c("text").alias("description"), c("text").alias("descriptionHtml"))).select("doc_id", "description")


@query("SELECT 'https://example.org/listings/' || doc_id AS url, lang AS last_change FROM (SELECT * FROM documents WHERE n_chars >= 300 ORDER BY doc_id LIMIT 5000)")
def sitemap(t):
    from tidewell.sources import snapshots

    rows = t("documents").select(c("doc_id").cast("string").alias("id"), (c("n_chars") < 300).alias("isExpired"), c("lang").alias("lastSeenAt"), c("doc_id").alias("_ord"))
    return snapshots.sitemap(rows, "https://example.org/listings/").select("url", c("lastSeenAt").alias("last_change"))


@query("""
WITH u AS (SELECT page_id, '/' || regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages), r(kind, pattern) AS (VALUES ('disallow', '/p'), ('allow', '/page'), ('disallow', '/1'), ('allow', '/1'), ('disallow', '/a')),
m AS (SELECT page_id, max(CASE WHEN kind = 'disallow' AND starts_with(path, pattern) THEN length(pattern) ELSE -1 END) AS no, max(CASE WHEN kind = 'allow' AND starts_with(path, pattern) THEN length(pattern) ELSE -1 END) AS yes FROM u, r GROUP BY page_id)
SELECT page_id, no < 0 OR yes >= no AS allowed FROM m
""")
def robots_verdict(t):
    from tidewell.sources import robots

    rules = robots.parse_robots("User-agent: *\nDisallow: /p\nAllow: /page\nDisallow: /1\nAllow: /1\nDisallow: /a\n", "tidewell")
    urls = t("pages").select("page_id", F.lit("o").alias("origin"), F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")).alias("path"))
    dim = urls.sparkSession.createDataFrame([("o", k, p, robots.pattern_regex(p)) for k, p in rules], "origin string, kind string, pattern string, regex string")
    return robots.verdicts(urls, dim).select("page_id", "allowed")


@query("SELECT p_brand AS term, CAST((row_number() OVER (ORDER BY p_brand) - 1 - 7 % (SELECT count(DISTINCT p_brand) FROM part) + (SELECT count(DISTINCT p_brand) FROM part)) % (SELECT count(DISTINCT p_brand) FROM part) AS BIGINT) AS turn FROM (SELECT DISTINCT p_brand FROM part) QUALIFY turn < 6")
def rotation(t):
    from tidewell.sources import connectors

    terms = t("part").select(c("p_brand").alias("term")).distinct().withColumn("ord", F.row_number().over(Window.orderBy("term")) - 1)  # a row for each brand
    return connectors.rotated(terms, 7, 6).select("term", c("turn").cast("bigint").alias("turn"))


@query("SELECT r_name || ' ' || n_name AS place_text, CASE WHEN contains(r_name || ' ' || n_name, 'MIDDLE EAST') THEN 'Middle East' WHEN contains(r_name || ' ' || n_name, 'EAST') THEN 'East' WHEN contains(r_name || ' ' || n_name, 'ASIA') THEN 'Asia' WHEN contains(r_name || ' ' || n_name, 'AMERICA') THEN 'America' END AS place FROM nation JOIN region ON r_regionkey = n_regionkey")
def gazetteer_match(t):
    from tidewell.functions import geo

    texts = t("nation").join(t("region"), c("r_regionkey") == c("n_regionkey")).select(F.concat_ws(" ", "r_name", "n_name").alias("place_text"))
    places = texts.sparkSession.createDataFrame([("East", "x", [], 0), ("Middle East", "y", ["near east"], 1), ("Asia", "z", [], 2), ("America", "w", [], 3)], "name string, region string, aliases array<string>, ord int")
    return texts.join(geo.match_places(texts, "place_text", places), c("place_text") == c("_text"), "left").select("place_text", "place")
