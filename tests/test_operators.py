"""Filters, search, merges and the normalising plan."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import geo, rules
from tidewell.operators import dedupe, facets, filters, merge, search, views
from tidewell.plans import normalize as plan
from tidewell.schema import LISTING, RAW
from tidewell.sources import snapshots

NOW = datetime(2024, 6, 1)


def test_query_parsing():
    q = search.parse_query('Red "Big Bolt" -old -')
    assert (q.terms, q.phrases, q.excluded) == (["red", "-"], ["big bolt"], ["old"])
    assert not search.parse_query("") and not search.parse_query(None)
    assert search.parse_query('-"a b"').phrases == ["a b"]


def test_pages():
    assert search.page_bounds(0, 3, 25) == (1, 25, 1, 0)
    assert search.page_bounds(101, 99, 500) == (2, 100, 2, 100)
    assert search.page_strip(5, 10) == [1, None, 3, 4, 5, 6, 7, None, 10]
    assert search.page_strip(1, 1) == [1]


@pytest.mark.parametrize("f", [filters.Filters(), filters.Filters(q="a b", cities=["Ottawa, ON", "x"], salary_min=5, include_pathway=False, sort="newest", page=3, page_size=50, has_salary=True)])
def test_filters_survive_urls(f):
    assert filters.Filters.from_query(f.to_query()) == f


def test_filters_ignore_junk():
    f = filters.Filters.from_query("page=x&within=7days&hasSalary=no&unknown=1&city=")
    assert f.page == 1 and f.posted_within_days == 7 and f.has_salary is False and f.cities == []
    assert filters.Filters(cities=["a", "b"], only_pathway=True).active() == 3


RELEVANCE = rules.RelevancePack(r"\bdata engineer\b", r"\bdata\b", r"\bclerk\b", r"\b(spark|sql|kafka)\b", r"\bdata\b", r"\bguard\b", r"\bsales\b", r"\bsecurity\b")
PACK = rules.RequirementPack([rules.Term("SQL")], [rules.Term("Spark"), rules.Term("Kafka")], [], r"(?i)(?:^|\n)requirements:", r"(?i)(?:^|\n)preferred:", r"(?i)(?:^|\n)benefits:")
POLICY = plan.Policy(RELEVANCE, PACK, [rules.Category("engineering", r"\bengineer\b", r"\bspark\b"), rules.Category("office", r"\bclerk\b")])


def raw(spark, *rows):
    base = dict(sourceId="lever", sourceName="Lever", sourceUrl="u", applyUrl="a", company="Acme Inc.", companyUrl=None, locationRaw="Toronto, ON", description="Spark and SQL", descriptionIsHtml=False, postedAt="2024-05-30", employmentTypeRaw=None, salaryRaw=None, departmentRaw=None, remoteHint=None, extra=None)
    names = [x.split(" ")[0] for x in RAW.replace("map<string,string>", "map<x>").split(", ")]
    return spark.createDataFrame([tuple({**base, "sourceJobId": str(i), "_ord": i, **r}[n] for n in names) for i, r in enumerate(rows)], RAW)


@pytest.fixture(scope="module")
def listings(spark):
    places = spark.createDataFrame([("Toronto", "GTA", [], 0), ("Ottawa", "East", [], 1)], "name string, region string, aliases array<string>, ord int")
    rows = raw(
        spark, dict(title="Senior Data Engineer - Remote", salaryRaw="$100,000 - $120,000"), dict(title="Data Engineer", sourceId="adzuna", postedAt="2024-05-01", description="Kafka " * 300), dict(title="Security guard"), dict(title=""), dict(title="Sales of data"),
        dict(title="Clerk", description="no signal"), dict(title="Clerk", description="spark sql", locationRaw="Paris"), dict(title="Clerk", description="spark sql kafka"), dict(title="Data Engineer", locationRaw="", remoteHint=True, company=" ", descriptionIsHtml=True, description="<p>Spark</p><script>x</script>", postedAt=None),
    )
    return plan.normalize(rows, places, POLICY, NOW).cache()


def test_normalize_reasons(listings):
    got = {r._ord: r.reject_reason for r in listings.collect()}
    assert got[0] is None and got[1] is None and got[7] is None and got[8] is None
    assert got[2] == "excluded by title" and got[3] == "missing title" and got[4] == "out of field" and got[5] == "pathway without signal"
    assert got[6].startswith("outside the region")


def test_normalize_fields(listings):
    r = {x._ord: x for x in listings.collect()}
    assert r[0].title == "Senior Data Engineer" and r[0].experienceLevel == "senior" and r[0].city == "Toronto" and r[0].salary.annualMax == 120000 and r[0].category == "engineering"
    assert r[8].company == "Unknown employer" and r[8].description == "Spark" and r[8].descriptionHtml == "<p>Spark</p>" and r[8].postedAt is None and r[8].workArrangement == "remote"
    assert r[7].isPathwayRole and len(r[0].id) == 16 and len(r[0].fingerprint) == 20
    assert r[0].fingerprint == r[1].fingerprint  # seniority doesn't tell listings apart


def test_listing_columns_match_the_schema(spark, listings):
    empty = spark.createDataFrame([], LISTING)
    assert plan.accepted(listings).columns == empty.columns


def test_dedupe(listings):
    got = {r.title: r for r in dedupe.dedupe(plan.accepted(listings)).collect()}
    top = got["Senior Data Engineer"]
    assert top.duplicateCount == 2 and top.postedAt == datetime(2024, 5, 1) and [a.sourceName for a in top.alsoPostedOn] == ["Lever"] and top.requirements.technologies == ["Spark", "Kafka"]


def test_search_end_to_end(listings):
    r = search.search(plan.accepted(listings), filters.Filters(q="data -kafka", sort="newest", page_size=1), NOW)
    assert r.total == 2 and r.pages == 2 and len(r.rows.collect()) == 1
    assert {x.facet for x in r.facets.collect()} >= {"categories", "companies", "skills"}
    only = search.search(plan.accepted(listings), filters.Filters(skills=["spark"], only_pathway=True), NOW)
    assert [x.title for x in only.rows.collect()] == ["Clerk"]


def test_merge_repeated_ids(spark):
    kind = "id string, firstSeenAt timestamp, lastSeenAt timestamp, isExpired boolean, isRepost boolean, repostOf string, _ord long"
    old = spark.createDataFrame([("a", datetime(2024, 1, 1), datetime(2024, 5, 31), False, True, "z", 0), ("b", None, None, False, False, None, 1), ("c", None, datetime(2024, 5, 11), True, False, None, 2), ("d", None, datetime(2024, 5, 29), False, False, None, 3)], kind)
    new = spark.createDataFrame([("a", datetime(2024, 6, 1), None, False, False, None, 0), ("a", datetime(2024, 6, 1), None, False, False, None, 1)], kind)
    m = merge.merge_snapshots(old, new, NOW)
    got = [(r.id, r.merge_status, r.isRepost, r.isExpired) for r in m.orderBy("merge_side", "_ord").collect()]
    assert got == [("a", "refreshed", True, False), ("a", "added", False, False), ("b", "dropped", False, True), ("c", "carried", False, True), ("d", "carried", False, False)]
    assert merge.merge_counts(m).first().carried == 2
    assert merge.sanity_check(20, 9) and merge.sanity_check(5, 0) and merge.sanity_check(20, 10) is None


def test_merge_null_and_hot_ids(spark):
    """Rows without an id never meet; only the first of an id's many rows takes over what was known."""
    kind = "id string, firstSeenAt timestamp, lastSeenAt timestamp, isExpired boolean, isRepost boolean, repostOf string, _ord long"
    old = spark.createDataFrame([(None, None, NOW, False, False, None, 0), ("h", datetime(2024, 1, 1), NOW, False, False, None, 1), ("h", datetime(2024, 2, 1), NOW, False, False, None, 2)], kind)
    new = spark.createDataFrame([(None, None, None, False, False, None, n) for n in range(3)] + [("h", None, None, False, False, None, n) for n in range(3, 40)], kind)
    got = merge.merge_snapshots(old, new, NOW).orderBy("_ord").collect()
    assert [r.merge_status for r in got] == ["added"] * 3 + ["refreshed"] + ["added"] * 36 and got[3].firstSeenAt == datetime(2024, 2, 1)


def test_overlay(spark):
    stored = spark.createDataFrame([("a", True, datetime(2024, 1, 1)), ("b", None, None)], "id string, is_expired boolean, first_seen_at timestamp")
    payload = spark.createDataFrame([(x, False, NOW) for x in "abc"], "id string, isExpired boolean, firstSeenAt timestamp")
    got = [tuple(r) for r in merge.overlay(payload, stored).orderBy("id").collect()]
    assert got == [("a", True, datetime(2024, 1, 1)), ("b", False, NOW), ("c", False, NOW)]


def test_region_of(spark):
    places = [geo.Place("Toronto", "GTA"), geo.Place("Toronto", "other"), geo.Place("Ottawa", "East")]
    cities = spark.createDataFrame([("Ottawa",), ("Toronto",), ("Paris",), (None,)], "city string")
    assert [r[0] for r in cities.select(geo.region_of(F.col("city"), places)).collect()] == ["East", "GTA", None, None]
    assert cities.limit(1).select(geo.region_of(F.col("city"), [])).first()[0] is None


def test_places_inside_words(spark):
    """The longest of the needles that stand inside; short ones don't count, and neither do texts shorter than any."""
    rows = [("Northbayville", None), ("xNorth Bay Easty", None), ("abcd", None), ("", None), (None, None)]
    texts = spark.createDataFrame(rows, "place_text string, x int")
    places = spark.createDataFrame([("North", "n", [], 0), ("North Bay", "b", ["northbay"], 1), ("abc", "a", [], 2)], "name string, region string, aliases array<string>, ord int")
    assert {r._text: r.place for r in geo.match_places(texts, "place_text", places).collect()} == {"Northbayville": "North Bay", "xNorth Bay Easty": "North Bay"}


def test_dashboard_lists(listings):
    rows = plan.accepted(listings)
    got = {}
    for r in facets.top_lists(rows, facets.dashboard_lists(), F.col("_ord")).orderBy("list", "rank").collect():
        got.setdefault(r.list, []).append((r.value, r.n))
    assert set(got) == {"category", "experience", "region", "city", "technologies", "employers", "source"}
    assert got["region"][0][0] == "GTA" and ("Remote (Canada)", 1) in got["region"] and sum(n for _, n in got["source"]) == rows.count()
    few = facets.top_lists(rows, [facets.Facet("tech", F.col("requirements.technologies"), 1)], F.col("_ord")).collect()
    assert [(r.value, r.rank) for r in few] == [("Spark", 1)]


def test_upper_median_and_trend(spark):
    from datetime import date

    df = spark.createDataFrame([(20001.0,), (20002.0,), (20003.0,), (20004.0,), (5.0,), (None,)], "v double")
    assert facets.upper_median(df, F.col("v")).first().median == 20003.0
    assert facets.upper_median(df.limit(0), F.col("v")).first().median is None
    assert facets.trend(df.limit(0).withColumn("d", F.current_date()), F.col("d"), date(2024, 1, 3), 3).count() == 3


def test_snapshots(spark, tmp_path, listings):
    rows = plan.accepted(listings)
    snapshots.publish(rows, str(tmp_path), "1")
    assert snapshots.read_first(spark, [str(tmp_path / "none"), f"{tmp_path}/run=1/full"], LISTING).count() == rows.count()
    assert snapshots.read_first(spark, [str(tmp_path / "none")], LISTING).count() == 0
    assert snapshots.client_projection(rows).where("descriptionHtml is not null or length(description) > 1200").count() == 0


def test_views(listings):
    rows = plan.accepted(listings)
    cards = {r.title: r for r in views.card(rows, NOW).collect()}
    top = cards["Senior Data Engineer"]
    assert top.pay == "$100,000 – $120,000/yr" and top.age == "2 days ago" and top.place == "Toronto, ON" and top.technologies == ["Spark"]
    one = rows.first().id
    assert [r.id for r in views.detail(rows, one, NOW).collect()] == [one]
    assert views.health(rows).first().open == rows.count()
