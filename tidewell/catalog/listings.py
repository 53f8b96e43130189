"""Levels, pay, titles and the whole normalising and merging plans over a whole table, whose rows are made from its keys by the same rule on both sides."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewell.functions import geo, rules, salary, text
from tidewell.operators import dedupe, facets, search
from tidewell.operators.filters import Filters
from tidewell.plans import normalize as plan
from tidewell.scratch import written

from . import query

c = F.col
NOW = datetime(2024, 6, 1)


def pick(choices: list, at):
    """Choice number `at` mod the number of choices."""
    return F.element_at(F.array(*(F.lit(x) for x in choices)), (at % len(choices)).cast("int") + 1)


def quoted(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" if isinstance(x, str) else str(x)


def picked(choices: list, at: str) -> str:
    return f"[{', '.join(map(quoted, choices))}][CAST(({at}) % {len(choices)} AS INT) + 1]"


def first_of(patterns: list[tuple[str, str]], value: str, other: str) -> str:
    """The name of the first pattern that the value has, in SQL. What follows the end of a word needs no look-ahead there."""
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, {quoted(p.replace('(?!i)', ''))}) THEN '{n}'" for n, p in patterns) + f" ELSE {other} END"


_TITLES = ["Senior Clerk", "Intern, kitchen", "Clerk", "Clerk II", "Director of sales", "Baker", "Team manager", "Lead cook", "Jr. driver", "Entry-level helper", "VP finance", "CTO", "Co-op student", "Tier 3 analyst", "Graduate nurse", "Staff writer", "Painter"]
_BODIES = [
    "", "at least 2 years of experience, full-time", "contract of 6 months", "student co-op", "no prior experience, seasonal", "12 years experience", "volunteer", "part-time", "student internship", "7+ years of relevant work experience", "regular hours", "new graduates welcome",
    "1 to 3 years of professional experience", "40 years of experience",
]
_YEARS = quoted(rules.YEARS)
_BAND = "CASE WHEN y <= 0 THEN 'entry' WHEN y <= 2 THEN 'junior' WHEN y <= 5 THEN 'mid' WHEN y <= 8 THEN 'senior' WHEN y IS NOT NULL THEN 'lead' WHEN regexp_matches(b, '\\b(entry[- ]?level|no prior experience|new graduates?)\\b') THEN 'entry' ELSE 'unknown' END"
_BELOW = f"CASE WHEN regexp_matches(b, '\\b(co-?op|work term)\\b') AND regexp_matches(b, '\\bstudent\\b') THEN 'coop' WHEN regexp_matches(b, '\\bintern(ship)?\\b') AND regexp_matches(b, '\\bstudent\\b') THEN 'internship' ELSE {_BAND} END"


@query(f"""
WITH r AS (SELECT o_orderkey, {picked(_TITLES, 'o_orderkey')} AS t, {picked(_BODIES, 'o_orderkey // 17')} AS b FROM orders),
y AS (SELECT *, nullif(regexp_extract(b, {_YEARS}, 1), '') AS a, nullif(regexp_extract(b, {_YEARS}, 2), '') AS z FROM r),
n AS (SELECT *, CASE WHEN CAST(a AS INT) <= 30 THEN CAST(a AS INT) END AS y FROM y)
SELECT o_orderkey, {first_of(rules.LEVELS, 'lower(t)', _BELOW)} AS level, {first_of(rules.EMPLOYMENT, "concat_ws(' | ', t, nullif(b, ''))", "'unknown'")} AS employment, y AS years, CASE WHEN z IS NOT NULL THEN a || '–' || z || ' years' WHEN a IS NOT NULL THEN a || '+ years' END AS label FROM n
""")
def levels_of_all(t):
    rows = t("orders").select("o_orderkey", pick(_TITLES, c("o_orderkey")).alias("t"), pick(_BODIES, F.floor(c("o_orderkey") / 17)).alias("b"))
    years, label = rules.years_experience(c("b"))
    return rows.select("o_orderkey", rules.experience_level(c("t"), c("b")).alias("level"), rules.employment_type(c("t"), c("b")).alias("employment"), years.alias("years"), label.alias("label"))


_SPOTS = ["Work from home", "Hybrid, 3 days in the office", "Ottawa", None, "remote (Canada)", "Virtual", "flexible hybrid", "partially remote", "", "Anywhere", "distribution centre", "2 days per week in office"]


@query(f"SELECT o_orderkey, coalesce(regexp_matches(s, {quoted(geo.REMOTE)}), false) AS remote, coalesce(regexp_matches(s, {quoted(geo.HYBRID)}), false) AS hybrid FROM (SELECT o_orderkey, {picked(_SPOTS, 'o_orderkey')} AS s FROM orders)")
def remote_of_all(t):
    s = pick(_SPOTS, c("o_orderkey"))
    return t("orders").select("o_orderkey", geo.is_remote(s).alias("remote"), geo.is_hybrid(s).alias("hybrid"))


#: Period, words for it, periods in a year, least amount, step.
_PERIODS = [("hour", " per hour", 2080, 20, 1), ("day", "/day", 260, 200, 10), ("week", " weekly", 52, 900, 20), ("biweekly", " every two weeks", 26, 1800, 50), ("month", " par mois", 12, 4000, 100), ("year", " annually", 1, 60000, 1000)]
_MONEY = [("CAD", "CAD $"), ("USD", "USD $"), ("EUR", "€"), ("GBP", "£"), ("CAD", "$")]


@query(f"""
WITH k AS (SELECT o_orderkey AS k, {picked([p[3] for p in _PERIODS], 'o_orderkey')} AS least, {picked([p[4] for p in _PERIODS], 'o_orderkey')} AS step, {picked([p[2] for p in _PERIODS], 'o_orderkey')} AS times FROM orders),
v AS (SELECT *, least + step * ((k // 30) % 40) AS low, least + step * ((k // 30) % 40) + step * (1 + k % 7) AS high FROM k)
SELECT k AS o_orderkey, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, {picked([m[0] for m in _MONEY], 'k // 6')} AS currency, {picked([p[0] for p in _PERIODS], 'k')} AS period, CAST(low * times AS BIGINT) AS annual_low, CAST(high * times AS BIGINT) AS annual_high FROM v
""")
def salaries_of_all(t):
    k = c("o_orderkey")
    least, step = pick([p[3] for p in _PERIODS], k), pick([p[4] for p in _PERIODS], k)
    low = least + step * (F.floor(k / 30) % 40)
    high = low + step * (1 + k % 7)
    # the higher amount comes first in some
    a, b = F.when(k % 11 == 0, high).otherwise(low), F.when(k % 11 == 0, low).otherwise(high)
    raw = F.concat(pick([m[1] for m in _MONEY], F.floor(k / 6)), F.format_number(a, 0), pick([" - ", " to ", " – "], F.floor(k / 5)), F.format_number(b, 0), pick([p[1] for p in _PERIODS], k))
    s = c("s")
    return t("orders").withColumn("s", salary.parse_salary(raw)).select("o_orderkey", s["min"].alias("low"), s["max"].alias("high"), s["currency"].alias("currency"), s["period"].alias("period"), s["annualMin"].alias("annual_low"), s["annualMax"].alias("annual_high"))


_NOISE = ["", " - Remote", " (Toronto)", " | Full-time", " - 12345", " (6 months)", " (H/F)", " - campus", "  "]


@query("SELECT p_partkey, p_name AS cleaned FROM part")
def titles_of_all(t):
    return t("part").select("p_partkey", text.clean_title(F.concat("p_name", pick(_NOISE, c("p_partkey")))).alias("cleaned"))


_RELEVANCE = rules.RelevancePack(r"\bdata engineer\b", r"\bdata\b", r"\bclerk\b", r"\b(spark|sql|kafka)\b", r"\bdata\b", r"\bguard\b", r"\bsales\b", r"\bsecurity\b")
_REQUIRED = rules.RequirementPack([rules.Term("SQL")], [rules.Term("Spark"), rules.Term("Kafka")], [rules.Term("First aid"), rules.Term("Forklift")], r"(?i)(?:^|\n)requirements:", r"(?i)(?:^|\n)preferred:", r"(?i)(?:^|\n)benefits:")
POLICY = plan.Policy(_RELEVANCE, _REQUIRED, [rules.Category("engineering", r"\bengineer\b", r"\bspark\b"), rules.Category("office", r"\bclerk\b")])
_ROLE = ["Senior Data Engineer", "Data Engineer", "Junior Data Engineer", "Security guard", "Sales clerk", "Clerk", "", "Data steward"]
_FIRM = ["Acme Inc.", "Beta Ltd", "  ", "Gamma"]
_WHERE = ["Toronto, ON", "Ottawa, Ontario", "Paris", "Remote, Canada", ""]
_SAID = ["Spark and SQL", "Kafka and Spark. 3 years of experience, first aid", "nothing of note but a forklift and first aid ticket"]
_PAID = [None, "$100,000 - $120,000 annually", "$40 - $50 per hour"]
_FROM = ["lever", "greenhouse", "adzuna"]


def made_listings(t):
    """Raw listings from the keys of orders, and what the plan makes of them."""
    k = c("o_orderkey")
    nothing = F.lit(None).cast("string")
    raw = t("orders").select(
        k.cast("string").alias("sourceJobId"), pick(_FROM, k).alias("sourceId"), F.upper(pick(_FROM, k)).alias("sourceName"), F.lit("u").alias("sourceUrl"), F.concat(F.lit("a"), k.cast("string")).alias("applyUrl"), pick(_ROLE, k).alias("title"), pick(_FIRM, F.floor(k / 8)).alias("company"), nothing.alias("companyUrl"),
        pick(_WHERE, F.floor(k / 32)).alias("locationRaw"), pick(_SAID, F.floor(k / 7)).alias("description"), F.lit(False).alias("descriptionIsHtml"), F.concat(F.lit("2024-05-"), F.lpad((1 + k % 28).cast("string"), 2, "0")).alias("postedAt"), nothing.alias("employmentTypeRaw"),
        pick(_PAID, F.floor(k / 5)).alias("salaryRaw"), nothing.alias("departmentRaw"), pick([None, True, False], F.floor(k / 160)).alias("remoteHint"), F.lit(None).cast("map<string,string>").alias("extra"), k.cast("long").alias("_ord"),
    )
    places = raw.sparkSession.createDataFrame([("Toronto", "GTA", [], 0), ("Ottawa", "East", [], 1)], "name string, region string, aliases array<string>, ord int")
    return plan.normalize(raw, places, POLICY, NOW)


def stored_listings(t, columns):
    """Accepted listings, computed once, as a stored snapshot is: the plan's expressions aren't repeated in every filter over them. Columns that the caller doesn't read aren't made."""
    return written(plan.accepted(made_listings(t)).select(*columns), "listings")


_MERGED = ["fingerprint", "sourceId", "sourceName", "sourceUrl", "applyUrl", "description", "postedAt", "salary", "requirements", "relevanceScore", "duplicateCount", "alsoPostedOn", "_ord"]
_SEARCHED = ["title", "company", "city", "region", "locationRaw", "summary", "description", "requirements", "sourceId", "sourceName", "salary", "postedAt", "rankScore", "workArrangement", "experienceLevel", "employmentType", "category", "isExpired", "_ord"]
_LISTED = ["category", "experienceLevel", "region", "city", "workArrangement", "requirements", "company", "sourceId", "_ord"]


_MADE = f"""
WITH r AS (SELECT o_orderkey AS k, {picked(_ROLE, 'o_orderkey')} AS t, {picked(_FIRM, 'o_orderkey // 8')} AS firm, {picked(_WHERE, 'o_orderkey // 32')} AS loc, {picked(_SAID, 'o_orderkey // 7')} AS d, {picked([0, 1, 2], 'o_orderkey // 5')} AS pay,
  {picked(_FROM, 'o_orderkey')} AS src, (o_orderkey // 160) % 3 = 1 AS hint, make_date(2024, 5, CAST(1 + o_orderkey % 28 AS INT)) AS posted FROM orders),
f AS (SELECT *, contains(lower(t), 'data engineer') AS core, contains(lower(t), 'data') AS weak, contains(lower(t), 'clerk') AS path, len(regexp_extract_all(t || chr(10) || d, '(?i)\\b(spark|sql|kafka)\\b')) AS hits, hint OR loc = 'Remote, Canada' AS remote,
  CASE loc WHEN 'Toronto, ON' THEN 'Toronto' WHEN 'Ottawa, Ontario' THEN 'Ottawa' END AS city, CASE WHEN trim(firm) = '' THEN 'Unknown employer' ELSE firm END AS company FROM r),
s AS (SELECT *, CASE WHEN contains(lower(t), 'guard') THEN 'excluded by title' WHEN contains(lower(t), 'sales') AND NOT core THEN 'out of field' WHEN NOT core AND NOT path AND NOT (weak AND hits >= 6) AND hits < 10 THEN 'not relevant' WHEN NOT core AND path AND hits < 1 THEN 'pathway without signal' END AS why,
  CASE WHEN core THEN 62.0 WHEN weak THEN 28.0 ELSE 0.0 END + least(26.0, hits * 2.2) AS base FROM f),
m AS (SELECT *, CASE WHEN why IS NULL THEN CAST(floor(least(greatest(CASE WHEN NOT core AND path AND hits >= 1 THEN greatest(base, 28.0 + least(18.0, hits * 2.5)) ELSE base END, 0), 100) + 0.5) AS INT) ELSE 0 END AS score,
  CASE WHEN contains(t, 'Senior') THEN 'senior' WHEN contains(t, 'Junior') THEN 'junior' WHEN contains(d, '3 years') THEN 'mid' ELSE 'unknown' END AS level, CASE WHEN remote THEN 'remote' WHEN city IS NOT NULL THEN 'onsite' ELSE 'unknown' END AS arrangement,
  CASE WHEN contains(d, 'Spark') AND contains(d, 'Kafka') THEN ['Spark', 'Kafka'] WHEN contains(d, 'Spark') THEN ['Spark'] ELSE [] END AS tech, CASE pay WHEN 1 THEN 100000 WHEN 2 THEN 83200 END AS annual_low FROM s),
n AS (SELECT *, CASE WHEN t = '' THEN 'missing title' WHEN why IS NOT NULL THEN why WHEN score < 25 THEN 'low relevance ' || score WHEN NOT (city IS NOT NULL OR (remote AND loc <> 'x')) THEN 'outside the region: ' || loc END AS reason FROM m)
"""


@query(f"{_MADE} SELECT k AS ord, substr(sha1(src || ':' || k), 1, 16) AS id, t AS title, company, city, arrangement, level, CAST(annual_low AS BIGINT) AS annual_low, array_to_string(tech, ',') AS technologies, score, strftime(posted, '%Y-%m-%d') AS posted, reason FROM n")
def normalize_listings(t):
    return made_listings(t).select(
        c("_ord").alias("ord"), "id", "title", "company", "city", c("workArrangement").alias("arrangement"), c("experienceLevel").alias("level"), c("salary.annualMin").alias("annual_low"), F.array_join("requirements.technologies", ",").alias("technologies"), c("relevanceScore").alias("score"),
        F.date_format("postedAt", "yyyy-MM-dd").alias("posted"), c("reject_reason").alias("reason"),
    )


_PRIORITY = "CASE src WHEN 'greenhouse' THEN 100 WHEN 'lever' THEN 98 ELSE 60 END"


@query(f"""{_MADE},
a AS (SELECT *, regexp_replace(regexp_replace(lower(t), '\\b(senior|junior)\\b', '', 'g'), '[^a-z0-9]+', '', 'g') || '|' || company || '|' || CASE WHEN remote AND city IS NULL THEN 'remote' ELSE coalesce(city, 'unknown') END AS fp FROM n WHERE reason IS NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY {_PRIORITY} DESC, length(d) DESC, posted DESC, k) AS place FROM a),
tech AS (SELECT fp, string_agg(x, ',' ORDER BY k, i) AS technologies FROM (SELECT fp, x, min(k) AS k, arg_min(i, k) AS i FROM (SELECT fp, k, unnest(tech) AS x, generate_subscripts(tech, 1) AS i FROM a) GROUP BY fp, x) GROUP BY fp),
g AS (SELECT fp, count(*) AS copies, min(posted) AS earliest, arg_min(annual_low, k) FILTER (annual_low IS NOT NULL) AS pay, max(score) AS score, coalesce(string_agg(upper(src) || ':a' || k, ',' ORDER BY place) FILTER (place > 1), '') AS others FROM e GROUP BY fp)
SELECT e.k AS ord, CAST(copies AS INT) AS copies, strftime(earliest, '%Y-%m-%d') AS posted, CAST(coalesce(e.annual_low, g.pay) AS BIGINT) AS annual_low, g.score AS score, coalesce(technologies, '') AS technologies, others FROM e JOIN g USING (fp) LEFT JOIN tech USING (fp) WHERE place = 1
""")
def dedupe_listings(t):
    out = dedupe.dedupe(stored_listings(t, _MERGED))
    others = F.array_join(F.transform("alsoPostedOn", lambda x: F.concat_ws(":", x["sourceName"], x["url"])), ",")
    return out.select(c("_ord").alias("ord"), c("duplicateCount").alias("copies"), F.date_format("postedAt", "yyyy-MM-dd").alias("posted"), c("salary.annualMin").alias("annual_low"), c("relevanceScore").alias("score"), F.array_join("requirements.technologies", ",").alias("technologies"), others.alias("others"))


@query(f"{_MADE} SELECT k AS ord, t AS title, strftime(posted, '%Y-%m-%d') AS posted FROM n WHERE reason IS NULL AND contains(lower(t), 'data') AND NOT contains(lower(d), 'kafka') AND pay IN (1, 2) ORDER BY posted DESC, k LIMIT 20 OFFSET 20")
def search_listings_page(t):
    found = search.search(stored_listings(t, _SEARCHED), Filters(q="data -kafka", sort="newest", page=2, page_size=20, salary_min=90000), NOW)
    return found.rows.select(c("_ord").alias("ord"), "title", F.date_format("postedAt", "yyyy-MM-dd").alias("posted"))


@query(f"""{_MADE},
a AS (SELECT *, CASE WHEN contains(t, 'Engineer') THEN 'engineering' WHEN contains(t, 'Clerk') THEN 'office' WHEN contains(d, 'Spark') THEN 'engineering' ELSE 'other' END AS category, coalesce(city, CASE WHEN remote THEN 'Remote' ELSE 'Other' END) AS place FROM n WHERE reason IS NULL AND contains(lower(t || ' ' || company || ' ' || coalesce(city, '') || ' ' || loc || ' ' || d), 'acme')),
v AS (SELECT 'categories' AS facet, category AS value FROM a UNION ALL SELECT 'experience', level FROM a UNION ALL SELECT 'arrangement', arrangement FROM a UNION ALL SELECT 'employment', 'unknown' FROM a UNION ALL SELECT 'cities', place FROM a UNION ALL SELECT 'companies', company FROM a UNION ALL SELECT 'sources', upper(src) FROM a UNION ALL SELECT 'skills', unnest(tech) FROM a
  UNION ALL SELECT 'certifications', 'First aid' FROM a WHERE contains(d, 'first aid') UNION ALL SELECT 'certifications', 'Forklift' FROM a WHERE contains(d, 'forklift'))
SELECT facet, value, count(*) AS n, CAST(row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, value) AS INT) AS rank FROM v WHERE value IS NOT NULL GROUP BY facet, value
""")
def search_listings_facets(t):
    return search.search(stored_listings(t, _SEARCHED), Filters(q="acme"), NOW).facets.select("facet", "value", "n", "rank")


@query(f"""{_MADE},
a AS (SELECT *, CASE WHEN contains(t, 'Engineer') THEN 'engineering' WHEN contains(t, 'Clerk') THEN 'office' WHEN contains(d, 'Spark') THEN 'engineering' ELSE 'other' END AS category,
  CASE WHEN city = 'Toronto' THEN 'GTA' WHEN city = 'Ottawa' THEN 'East' WHEN remote THEN 'Remote (Canada)' ELSE 'Unspecified' END AS region, coalesce(city, CASE WHEN remote THEN 'Remote' ELSE 'Unspecified' END) AS place FROM n WHERE reason IS NULL),
v AS (
  SELECT 'category' AS list, category AS value, k, 0 AS pos FROM a UNION ALL SELECT 'experience', level, k, 0 FROM a UNION ALL SELECT 'region', region, k, 0 FROM a UNION ALL SELECT 'city', place, k, 0 FROM a
  UNION ALL SELECT 'employers', company, k, 0 FROM a UNION ALL SELECT 'source', src, k, 0 FROM a UNION ALL SELECT 'technologies', unnest(tech), k, generate_subscripts(tech, 1) - 1 FROM a
  UNION ALL SELECT 'certifications', 'First aid', k, 0 FROM a WHERE contains(d, 'first aid') UNION ALL SELECT 'certifications', 'Forklift', k, 1 FROM a WHERE contains(d, 'forklift'))
SELECT list, value, count(*) AS n, CAST(row_number() OVER (PARTITION BY list ORDER BY count(*) DESC, min(k * 100 + pos)) AS INT) AS rank FROM v GROUP BY list, value
""")
def dashboard_lists(t):
    return facets.top_lists(stored_listings(t, _LISTED), facets.dashboard_lists(), c("_ord"))
