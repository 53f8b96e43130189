"""Text, date, pay and rule expressions over the test tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from tidewell.functions import dates, geo, rules, salary, text

from . import query
from .listings import pick, picked

c = F.col
NOW = datetime(2024, 6, 1)


def dealt(t, table: str, key: str, rows: list[tuple], names: list[str]):
    """Every row of a table with the columns of rows[key mod number of rows]; id: the key."""
    return t(table).select(c(key).alias("id"), *(pick([r[i] for r in rows], c(key)).alias(x) for i, x in enumerate(names)))


def spread(df, key: str):
    """Dealt out by key; the number is given, so that small rows which are much work aren't put together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def expected(table: str, key: str, rows: list[tuple], names: dict[str, str]) -> str:
    """The same in SQL for what is expected: names with their types."""
    return f"SELECT {key} AS id, " + ", ".join(f"CAST({picked([r[i] for r in rows], key)} AS {kind}) AS {x}" for i, (x, kind) in enumerate(names.items())) + f" FROM {table}"


_ENT = "replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"')"
_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?i)<li\b[^>]*>', chr(10) || '• ', 'g'), '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|blockquote)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
_TIDY = rf"regexp_replace(regexp_replace({_ENT.format(_PLAIN)}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


@query(rf"SELECT page_id, array_to_string(list_transform(string_split(regexp_replace({_TIDY}, '^\s+|\s+$', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)) AS plain FROM pages")
def html_to_text(t):
    return t("pages").select("page_id", text.html_to_text(c("html")).alias("plain"))


_TAG = r"</?[a-zA-Z][a-zA-Z0-9]*(?:[^A-Za-z0-9_](?s:.*))?$"
_HREF = r"""href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>]+))"""
_ALLOWED = "p br ul ol li strong b em i u h1 h2 h3 h4 h5 h6 a blockquote code pre hr span div table thead tbody tr td th"


@query(rf"""
WITH d AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<script.*?</script>', '', 'gis'), '<style.*?</style>', '', 'gis'), '<iframe.*?</iframe>', '', 'gis'), '<(object|embed|form|input|button|link|meta|base)\b[^>]*>', '', 'gi'), '>') AS p FROM pages),
s AS (SELECT page_id, len(p) AS n, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM d), t AS (SELECT *, CASE WHEN i < n THEN regexp_extract(s, '{_TAG}') ELSE '' END AS tag FROM s),
a AS (SELECT *, lower(regexp_extract(tag, '^</?([a-zA-Z0-9]+)', 1)) AS name, trim(regexp_extract(tag, '{_HREF}', 1, 'i') || regexp_extract(tag, '{_HREF}', 2, 'i') || regexp_extract(tag, '{_HREF}', 3, 'i')) AS url FROM t),
k AS (SELECT *, CASE WHEN i = n THEN '' WHEN tag = '' THEN '>' WHEN NOT list_contains(string_split('{_ALLOWED}', ' '), name) THEN '' WHEN starts_with(tag, '</') THEN '</' || name || '>' WHEN name <> 'a' THEN '<' || name || '>'
  WHEN regexp_matches(url, '^(?i)https?://') THEN '<a href="' || replace(url, '"', '&quot;') || '" target="_blank" rel="nofollow noopener noreferrer">' ELSE '<a>' END AS shown FROM a)
SELECT page_id, regexp_replace(regexp_replace(string_agg(left(s, length(s) - length(tag)) || shown, '' ORDER BY i), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS safe FROM k GROUP BY page_id
""")
def html_sanitize(t):
    return t("pages").select("page_id", text.sanitize_html(c("html")).alias("safe"))


@query(r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents), k AS (SELECT doc_id, s, left(s, 280) AS cut, reverse(left(s, 280)) AS back FROM d),
p AS (SELECT *, greatest(CASE WHEN instr(back, ' .') > 0 THEN 280 - instr(back, ' .') - 1 ELSE -1 END, CASE WHEN instr(back, ' !') > 0 THEN 280 - instr(back, ' !') - 1 ELSE -1 END, CASE WHEN instr(back, ' ?') > 0 THEN 280 - instr(back, ' ?') - 1 ELSE -1 END) AS stop FROM k)
SELECT doc_id, CASE WHEN length(s) <= 280 THEN s WHEN stop > 140 THEN left(cut, stop + 1) ELSE left(cut, CASE WHEN instr(back, ' ') > 0 THEN 280 - instr(back, ' ') ELSE 279 END) || '…' END AS summary FROM p
""")
def summarize(t):
    return t("documents").select("doc_id", text.summarize(c("text")).alias("summary"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '\\b(senior|junior|lead|principal|staff|intermediate|associate)\\b', '', 'g'), '[^a-z0-9]+', '', 'g') AS key, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part")
def title_normalize(t):
    return t("part").select("p_partkey", text.title_key(c("p_name")).alias("key"), text.normalize_title(c("p_name")).alias("title"))


_TITLES = [
    (1, "Sr Data Analyst - Remote", "Senior Data Analyst"), (2, "soc analyst (Toronto)", "SOC Analyst"), (3, "Jr. Developer | Full-time", "Junior. Developer"), (4, "Manager of the store - 12345", "Manager of the Store"), (5, "Clerk (6 months)", "Clerk"),
    (6, "Engineer iii", "Engineer III"), (7, "  Cook  ", "Cook"), (8, "IT security eng.", "IT Security Engineer."), (9, "Nurse (H/F)", "Nurse"), (10, "Welder - campus", "Welder"),
]


@query(expected("part", "p_partkey", [r[2:] for r in _TITLES], {"title": "VARCHAR"}))
def title_clean_corpus(t):
    return dealt(t, "part", "p_partkey", [r[1:2] for r in _TITLES], ["raw"]).select("id", text.normalize_title(c("raw")).alias("title"))


@query("SELECT DISTINCT source, left(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(text)), '&', ' and ', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS slug, doc_id FROM documents")
def slugify(t):
    return t("documents").select("source", text.slugify(c("text")).alias("slug"), "doc_id")


@query("SELECT s_suppkey, regexp_replace(regexp_replace(lower(s_name || ' Corp Inc. Canada'), '[^a-z0-9]+', '-', 'g'), '-corp-inc-canada$', '') AS key FROM supplier")
def company_key(t):
    return t("supplier").select("s_suppkey", text.company_key(F.concat("s_name", F.lit(" Corp Inc. Canada"))).alias("key"))


@query("SELECT doc_id, left(sha1(source || ':' || doc_id), 16) AS id, left(sha1(regexp_replace(lower(source), '[^a-z0-9]+', '', 'g') || '|' || lang || '|' || CASE WHEN doc_id % 2 = 0 THEN 'remote' ELSE 'unknown' END), 20) AS fp FROM documents")
def ids_and_fingerprints(t):
    return t("documents").select("doc_id", text.listing_id(c("source"), c("doc_id").cast("string")).alias("id"), text.fingerprint(c("source"), c("lang"), F.lit(None).cast("string"), c("doc_id") % 2 == 0).alias("fp"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.\-]{{2,}}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.\-]{{2,}}'), 1) AS i FROM documents),
n AS (SELECT doc_id, w, count(*) AS n, min(i) AS i FROM w WHERE w NOT IN ({_STOP}) AND length(w) <= 30 GROUP BY doc_id, w), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS k FROM n)
SELECT doc_id, string_agg(w, ',' ORDER BY k) AS words FROM r WHERE k <= 10 GROUP BY doc_id
""")
def keywords_top(t):
    found = F.array_join(text.keywords(c("text"), 10), ",")
    # what one task reads, a row group at least, is dealt to as many as a shuffle has; exploded, since a filter on words would work them out once more
    return spread(t("documents").select("doc_id", "text"), "doc_id").select("doc_id", F.explode(F.filter(F.array(found), lambda w: w != "")).alias("words"))


@query("""
WITH p AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')[1:400]) AS a, list_distinct(regexp_extract_all(lower(lang || ' ' || source || ' ' || text), '[a-z0-9]{4,}')[1:400]) AS b FROM documents)
SELECT doc_id, CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0.0 END AS similarity FROM p
""")
def overlap_similarity(t):
    return t("documents").select("doc_id", text.overlap_similarity(c("text"), F.concat_ws(" ", "lang", "source", "text")).alias("similarity"))


@query("SELECT o_orderkey, o_orderdate AS a, date_trunc('day', o_orderdate) AS b, date_trunc('day', o_orderdate) AS c, TIMESTAMP '2024-06-01' - to_days(CAST(o_orderkey % 30 AS INT)) AS d FROM orders")
def to_iso(t):
    day = c("o_orderdate").cast("timestamp")
    say = {"a": F.date_format(day, "yyyy-MM-dd HH:mm:ss"), "b": F.date_format(day, "MMMM d, yyyy"), "c": F.concat(F.lit("Posted "), F.date_format(day, "dd MMMM yyyy")), "d": F.concat((c("o_orderkey") % 30).cast("string"), F.lit(" days ago"))}
    return t("orders").select("o_orderkey", *(dates.parse_date(x, NOW).cast("timestamp_ntz").alias(k) for k, x in say.items()))


_DATES = [(1, "1717200000", 1717200000), (2, "1717200000123", 1717200000), (3, "13 août 2023", 1691884800), (4, "il y a 2 jours", 1717027200), (5, "5 hours ago", 1717182000), (6, "today", 1717200000), (7, "hier", 1717113600), (8, "soon", None), (9, "2024-02-30", None), (10, "3 months ago", 1709424000)]


@query(expected("orders", "o_orderkey", [r[2:] for r in _DATES], {"secs": "BIGINT"}))
def date_corpus(t):
    return dealt(t, "orders", "o_orderkey", [r[1:2] for r in _DATES], ["raw"]).select("id", F.floor(dates.micros(dates.parse_date(c("raw"), NOW)) / 1_000_000).alias("secs"))


@query("""
WITH e AS (SELECT event_id, floor((epoch_us(TIMESTAMP '2024-02-20') - epoch_us(ts)) / 86400000000.0) AS d, floor((epoch_us(TIMESTAMP '2024-02-20') - epoch_us(ts)) / 3600000000.0) AS h FROM events)
SELECT event_id, CAST(d AS BIGINT) AS days, CASE WHEN d <= 0 AND h <= 1 THEN 'Just posted' WHEN d <= 0 THEN CAST(h AS BIGINT) || 'h ago' WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN CAST(d AS BIGINT) || ' days ago' WHEN d < 14 THEN '1 week ago' WHEN d < 31 THEN CAST(floor(d / 7) AS BIGINT) || ' weeks ago' WHEN d < 60 THEN '1 month ago' ELSE CAST(floor(d / 30) AS BIGINT) || ' months ago' END AS label, d > 40 AS expired FROM e
""")
def relative_time(t):
    now = datetime(2024, 2, 20)
    return t("events").select("event_id", dates.days_since(c("ts"), now).alias("days"), dates.relative_time(c("ts"), now).alias("label"), dates.is_expired(c("ts"), now, 40).alias("expired"))


@query("""
WITH a AS (SELECT c_custkey, CAST(floor(abs(c_acctbal)) AS BIGINT) + 10 AS v FROM customer)
SELECT c_custkey, CAST(v AS DOUBLE) AS low, CAST(v + 5 AS DOUBLE) AS high, 'CAD' AS currency, CASE WHEN c_custkey % 2 = 0 THEN 'hour' ELSE 'year' END AS period, CAST(v * CASE WHEN c_custkey % 2 = 0 THEN 2080 ELSE 1 END AS BIGINT) AS annual_low,
CASE WHEN c_custkey % 2 = 0 THEN '$' || printf('%.2f', CAST(v AS DOUBLE)) || ' – $' || printf('%.2f', CAST(v + 5 AS DOUBLE)) || '/hr' ELSE '$' || format('{:,}', v) || ' – $' || format('{:,}', v + 5) || '/yr' END AS shown FROM a
""")
def salary_parse(t):
    v = F.floor(F.abs("c_acctbal")) + 10
    raw = F.concat(F.lit("$"), F.format_number(v, 0), F.lit(" - $"), F.format_number(v + 5, 0), F.when(c("c_custkey") % 2 == 0, " per hour").otherwise(" annually"))
    s = c("s")
    return t("customer").withColumn("s", salary.parse_salary(raw)).select("c_custkey", s["min"].alias("low"), s["max"].alias("high"), s["currency"].alias("currency"), s["period"].alias("period"), s["annualMin"].alias("annual_low"), salary.format_salary(s).alias("shown"))


_PAY = [
    (1, "$95,000", 95000, None, "year", 95000), (2, "$45 - $55 per hour", 45, 55, "hour", 93600), (3, "80k to 100k", 80000, 100000, "year", 80000), (4, "$95000", 950, None, "week", 49400), (5, "$95000 - $120000", 120, 95000, "year", 120),
    (6, "none", None, None, None, None), (7, "USD 1,500 weekly", 1500, None, "week", 78000), (8, "$120,000 - $90,000 a year", 90000, 120000, "year", 90000), (9, "$4,000 par mois", 4000, None, "month", 48000), (10, "$30 - $40, every two weeks", 30, 40, "biweekly", 780),
]


@query(expected("customer", "c_custkey", [r[2:] for r in _PAY], {"low": "DOUBLE", "high": "DOUBLE", "period": "VARCHAR", "annual": "BIGINT"}))
def salary_corpus(t):
    rows = dealt(t, "customer", "c_custkey", [r[1:2] for r in _PAY], ["raw"]).withColumn("s", salary.parse_salary(c("raw")))
    return rows.select("id", c("s.min").alias("low"), c("s.max").alias("high"), c("s.period").alias("period"), c("s.annualMin").alias("annual"))


@query("SELECT c_custkey, '$' || format('{:,}', CAST(floor(abs(c_acctbal)) AS BIGINT) + 50000) || ' - $' || format('{:,}', CAST(floor(abs(c_acctbal)) AS BIGINT) + 60000) AS found FROM customer")
def salary_find(t):
    v = F.floor(F.abs("c_acctbal"))
    body = F.concat(F.lit("We hire.\nPay range: $"), F.format_number(v + 50000, 0), F.lit("  -  $"), F.format_number(v + 60000, 0), F.lit("\nApply now"))
    return t("customer").select("c_custkey", salary.find_salary(body).alias("found"))


_VOCABULARY = [rules.Term("anvil"), rules.Term("hot item", ("hot gizmo", "hot ring")), rules.Term("bolt", ("rod",)), rules.Term("ring"), rules.Term("large plate")]
_FOUND = "list_filter([CASE WHEN regexp_matches(p_name, '(?i)(^|[^A-Za-z0-9])anvil($|[^A-Za-z0-9])') THEN 'anvil' END, CASE WHEN regexp_matches(p_name, '(?i)(^|[^A-Za-z0-9])hot[ _-]+(item|gizmo|ring)($|[^A-Za-z0-9])') THEN 'hot item' END, CASE WHEN regexp_matches(p_name, '(?i)(^|[^A-Za-z0-9])(bolt|rod)($|[^A-Za-z0-9])') THEN 'bolt' END, CASE WHEN regexp_matches(p_name, '(?i)(^|[^A-Za-z0-9])ring($|[^A-Za-z0-9])') THEN 'ring' END, CASE WHEN regexp_matches(p_name, '(?i)(^|[^A-Za-z0-9])large[ _-]+plate($|[^A-Za-z0-9])') THEN 'large plate' END], lambda x: x IS NOT NULL)"


@query(f"SELECT p_partkey, array_to_string({_FOUND}, ',') AS terms FROM part")
def terms_found(t):
    return t("part").select("p_partkey", F.array_join(rules.find_terms(c("p_name"), _VOCABULARY), ",").alias("terms"))


_PACK = rules.RequirementPack(
    [rules.Term("writing"), rules.Term("driving")], [rules.Term("spark"), rules.Term("sql"), rules.Term("kafka")], [rules.Term("first aid")],
    r"(?i)(?:^|\n)\s*(?:requirements|must have)\s*:", r"(?i)(?:^|\n)\s*(?:nice to have|preferred)\s*:", r"(?i)(?:^|\n)\s*(?:benefits|about us)\s*:", [("degree", r"(?i)\bdegree\b"), ("diploma", r"(?i)\bdiploma\b")],
)
_FILL = "We look for people who like to learn and to share what they know."
_BODIES = [
    (1, f"Requirements: Spark and writing. {_FILL}\nNice to have: Kafka. {_FILL}\nBenefits: SQL lunch", "writing,spark", "kafka,sql", "", None),
    (2, "Spark, SQL and driving. 3-5 years of experience. A degree and first aid.", "driving,spark,sql", "", "degree", "3–5 years"),
    (3, f"Preferred: SQL. {_FILL}", "", "sql", "", None), (4, "nothing here", "", "", "", None), (5, "10+ years of relevant work experience, a diploma or degree", "", "", "degree,diploma", "10+ years"),
]


@query(expected("part", "p_partkey", [r[2:] for r in _BODIES], {x: "VARCHAR" for x in ("required", "preferred", "education", "years")}))
def required_vs_preferred(t):
    rows = dealt(t, "part", "p_partkey", [r[1:2] for r in _BODIES], ["body"]).withColumn("r", rules.extract_requirements(c("body"), _PACK))
    return rows.select("id", F.array_join("r.requiredSkills", ",").alias("required"), F.array_join("r.preferredSkills", ",").alias("preferred"), F.array_join("r.education", ",").alias("education"), c("r.yearsExperience").alias("years"))


_ASKED = [("Spark and writing", "'writing', 'spark'"), ("SQL", "'sql'"), ("a good mood", ""), ("driving with Kafka", "'driving', 'kafka'")]
_LIKED = [("Kafka", "'kafka'"), ("SQL and Spark", "'spark', 'sql'"), ("none of these", "")]
_GIVEN = [("lunch", ""), ("SQL lunch", "'sql'")]
_SCHOOL = [("", ""), ("A degree.", "degree"), ("A diploma or degree.", "degree,diploma")]
_TICKETS = [("", ""), ("First aid is needed.", "first aid"), ("Bring your first aid and forklift tickets.", "first aid,forklift")]
_LISTED = replace(_PACK, certifications=[rules.Term("first aid"), rules.Term("forklift")])


def _among(choices: list[tuple], at: str) -> str:
    return f"[{', '.join(f'[{x}]::VARCHAR[]' for _, x in choices)}][CAST(({at}) % {len(choices)} AS INT) + 1]"


@query(f"""
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 4 AS sections, {_among(_ASKED, 'o_orderkey // 4')} AS a, {_among(_LIKED, 'o_orderkey // 16')} AS b, {_among(_GIVEN, 'o_orderkey // 48')} AS c FROM orders),
p AS (SELECT *, list_filter(['writing', 'driving', 'spark', 'sql', 'kafka'], lambda x: list_contains(list_concat(a, list_concat(b, c)), x)) AS pool FROM r),
q AS (SELECT *, list_filter(pool, lambda x: CASE sections WHEN 0 THEN list_contains(a, x) WHEN 1 THEN list_contains(a, x) OR list_contains(b, x) ELSE false END) AS req, list_filter(CASE WHEN sections IN (0, 2) THEN b ELSE [] END, lambda x: NOT (sections = 0 AND list_contains(a, x))) AS pref FROM p),
l AS (SELECT *, list_filter(pool, lambda x: NOT list_contains(req, x) AND NOT list_contains(pref, x)) AS rest FROM q)
SELECT k AS id, array_to_string(CASE WHEN sections = 3 THEN pool WHEN len(req) = 0 THEN rest ELSE req END, ',') AS required, array_to_string(CASE WHEN sections = 3 THEN [] WHEN len(req) = 0 THEN pref ELSE list_concat(pref, rest) END, ',') AS preferred,
  array_to_string(list_filter(pool, lambda x: x IN ('spark', 'sql', 'kafka')), ',') AS technologies, {picked([x for _, x in _TICKETS], 'k // 96')} AS certifications, {picked([x for _, x in _SCHOOL], 'k // 288')} AS education FROM l
""")
def requirements_of_all(t):
    """Without a heading of its own, what is liked stands in the section of what is required, and what is asked for before any section."""
    k = c("o_orderkey")
    part = lambda choices, n: pick([x for x, _ in choices], F.floor(k / n))
    headed = lambda heading, there, said: F.when(there, F.concat(F.lit(f"\n{heading} "), said)).otherwise(F.concat(F.lit(" Also "), said))
    fill = F.lit(f". {_FILL}")
    body = F.concat(
        F.lit("We hire."), headed("Requirements:", (k % 4).isin(0, 1), part(_ASKED, 4)), fill, headed("Preferred:", (k % 4).isin(0, 2), part(_LIKED, 16)), fill,
        F.lit("\nBenefits: "), part(_GIVEN, 48), fill, F.lit("\n"), part(_TICKETS, 96), F.lit("\n"), part(_SCHOOL, 288),
    )
    rows = t("orders").select(k.alias("id"), rules.extract_requirements(body, _LISTED).alias("r"))
    named = {"required": "requiredSkills", "preferred": "preferredSkills", "technologies": "technologies", "certifications": "certifications", "education": "education"}
    return rows.select("id", *(F.array_join(c("r")[x], ",").alias(y) for y, x in named.items()))


_ROLES = [
    (1, "Senior Clerk", "", "senior", "unknown"), (2, "Intern, kitchen", "", "internship", "internship"), (3, "Clerk", "at least 2 years of experience, full-time", "junior", "full_time"), (4, "Clerk II", "contract of 6 months", "mid", "contract"), (5, "Director", "part-time", "director", "part_time"),
    (6, "Baker", "student co-op", "coop", "internship"), (7, "Baker", "no prior experience, seasonal", "entry", "temporary"), (8, "Baker", "12 years experience", "lead", "unknown"), (9, "Team manager", "volunteer", "manager", "volunteer"), (10, "Baker", "", "unknown", "unknown"),
]


@query(expected("customer", "c_custkey", [r[3:] for r in _ROLES], {"level": "VARCHAR", "employment": "VARCHAR"}))
def experience_level(t):
    rows = dealt(t, "customer", "c_custkey", [r[1:3] for r in _ROLES], ["title", "body"])
    return rows.select("id", rules.experience_level(c("title"), c("body")).alias("level"), rules.employment_type(c("title"), c("body")).alias("employment"))


_RELEVANCE = rules.RelevancePack(r"\b(red|blue) (bolt|rod|ring)\b", r"\b(red|blue|hot)\b", r"\b(old|new) \w+", r"\b(plate|gear|anvil|brand)\w*", r"\bbrand#1", r"\bcold widget\b", r"\bsmall\b", r"\bgizmo\b")


@query(r"""
WITH p AS (SELECT p_partkey, p_name AS t, p_type AS d, p_name || chr(10) || p_brand || chr(10) || p_type AS body, lower(p_brand) AS dept FROM part),
s AS (SELECT *, regexp_matches(t, '(?i)\b(red|blue) (bolt|rod|ring)\b') AS core, regexp_matches(t, '(?i)\b(red|blue|hot)\b') AS weak, regexp_matches(t, '(?i)\b(old|new) \w+') AS path, len(regexp_extract_all(body, '(?i)\b(plate|gear|anvil|brand)\w*')) AS hits FROM p),
b AS (SELECT *, CASE WHEN core THEN 62.0 WHEN weak THEN 28.0 ELSE 0.0 END + least(26.0, hits * 2.2) + CASE WHEN regexp_matches(dept, '(?i)\bbrand#1') THEN 8.0 ELSE 0.0 END AS base FROM s),
r AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)\bcold widget\b') THEN 'excluded by title' WHEN regexp_matches(t, '(?i)\bsmall\b') AND NOT core THEN 'out of field' WHEN NOT core AND NOT path AND NOT (weak AND hits >= 6) AND hits < 10 THEN 'not relevant' WHEN NOT core AND path AND hits < 1 THEN 'pathway without signal' END AS reason FROM b)
SELECT p_partkey, CASE WHEN reason IS NULL THEN CAST(floor(least(greatest(CASE WHEN NOT core AND path AND hits >= 1 THEN greatest(base, 28.0 + least(18.0, hits * 2.5)) ELSE base END, 0), 100) + 0.5) AS INT) ELSE 0 END AS score, reason IS NULL AND NOT core AND path AS is_pathway, reason FROM r
""")
def classify_score(t):
    rows = t("part").withColumn("k", rules.classify(c("p_name"), c("p_type"), c("p_brand"), _RELEVANCE))
    return rows.select("p_partkey", c("k.score").alias("score"), c("k.isPathway").alias("is_pathway"), c("k.rejectReason").alias("reason"))


_CATEGORIES = [rules.Category("fasteners", r"\b(bolt|rod)\b", r"\bring\b"), rules.Category("colours", r"\b(red|blue)\b", r"\bbrand#1"), rules.Category("heat", r"\b(hot|cold)\b"), rules.Category("sheets", r"\bplate\b", r"\blarge\b")]


@query(r"""
WITH p AS (SELECT p_partkey, p_name AS t, p_name || chr(10) || p_brand AS b, contains(p_name, 'old') AS pathway FROM part),
s AS (SELECT p_partkey, pathway, i, cat, sum(v) AS s FROM (
  SELECT p_partkey, pathway, 0 AS i, 'fasteners' AS cat, (CASE WHEN regexp_matches(t, '\b(bolt|rod)\b') THEN 10 ELSE 0 END) + (CASE WHEN regexp_matches(b, '\bring\b') THEN 3 ELSE 0 END) AS v FROM p
  UNION ALL SELECT p_partkey, pathway, 1, 'colours', (CASE WHEN regexp_matches(t, '\b(red|blue)\b') THEN 10 ELSE 0 END) + (CASE WHEN regexp_matches(b, '(?i)\bbrand#1') THEN 3 ELSE 0 END) FROM p
  UNION ALL SELECT p_partkey, pathway, 2, 'heat', CASE WHEN regexp_matches(t, '\b(hot|cold)\b') THEN 10 ELSE 0 END FROM p
  UNION ALL SELECT p_partkey, pathway, 3, 'sheets', (CASE WHEN regexp_matches(t, '\bplate\b') THEN 10 ELSE 0 END) + (CASE WHEN regexp_matches(b, '\blarge\b') THEN 3 ELSE 0 END) FROM p) GROUP BY ALL HAVING sum(v) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, i) AS k FROM s),
top AS (SELECT p.p_partkey, CASE WHEN r.cat IS NULL THEN CASE WHEN p.pathway THEN 'adjacent_it' ELSE 'other' END WHEN p.pathway AND r.s < 10 THEN 'adjacent_it' ELSE r.cat END AS category FROM p LEFT JOIN r ON r.p_partkey = p.p_partkey AND r.k = 1)
SELECT top.p_partkey, category, coalesce(string_agg(r.cat, ',' ORDER BY r.k), '') AS secondary FROM top LEFT JOIN r ON r.p_partkey = top.p_partkey AND r.k > 1 AND r.s >= 5 AND r.cat <> category GROUP BY ALL
""")
def categorize(t):
    got = rules.categorize(c("p_name"), F.concat_ws("\n", "p_name", "p_brand"), c("p_name").contains("old"), _CATEGORIES)
    return t("part").withColumn("g", got).select("p_partkey", c("g.category").alias("category"), F.array_join("g.secondary", ",").alias("secondary"))


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 90 AS INT) AS relevance, CASE WHEN o_orderkey % 9 <> 0 THEN (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(o_orderdate)) / 86400000000.0 ELSE 45 END AS age, o_totalprice AS p FROM orders)
SELECT o_orderkey, CAST(floor(least(greatest(relevance + CASE WHEN age <= 1 THEN 18 WHEN age <= 3 THEN 14 WHEN age <= 7 THEN 10 WHEN age <= 14 THEN 5 WHEN age <= 30 THEN 1 WHEN age > 60 THEN -12 ELSE -5 END + CASE WHEN p > 200000 THEN 6 ELSE 0 END + CASE WHEN o_orderkey % 2000 > 1200 THEN 4 WHEN o_orderkey % 2000 < 300 THEN -8 ELSE 0 END
 + CASE WHEN o_orderkey % 4 = 0 THEN 8 WHEN o_orderkey % 4 = 1 THEN 4 ELSE 0 END + CASE WHEN o_orderkey % 10 = 3 THEN -10 ELSE 0 END + CASE WHEN o_orderkey % 20 = 7 THEN -40 ELSE 0 END, 0), 150) + 0.5) AS INT) AS rank FROM o
""")
def rank_score(t):
    k = c("o_orderkey")
    age = F.when(k % 9 != 0, (F.unix_micros(F.lit("2001-08-02").cast("timestamp")) - F.unix_micros(c("o_orderdate").cast("timestamp"))) / 86_400_000_000)
    return t("orders").select("o_orderkey", rules.rank_score((k % 90).cast("int"), age, c("o_totalprice") > 200000, k % 2000, k % 4 == 0, k % 4 == 1, k % 20 == 7, k % 10 == 3).alias("rank"))


_PLACES = [(1, "Work from home", True, False), (2, "Hybrid, 3 days in the office", False, True), (3, "Ottawa", False, False), (4, None, False, False)]


@query(expected("supplier", "s_suppkey", [r[2:] for r in _PLACES], {"remote": "BOOLEAN", "hybrid": "BOOLEAN"}))
def remote_flags(t):
    return dealt(t, "supplier", "s_suppkey", [r[1:2] for r in _PLACES], ["place"]).select("id", geo.is_remote(c("place")).alias("remote"), geo.is_hybrid(c("place")).alias("hybrid"))


@query("SELECT doc_id, lower(source || ' ' || chr(10) || ' ' || lang || ' ' || chr(10) || ' ' || left(text, 4000)) AS hay FROM documents")
def haystack(t):
    return t("documents").select("doc_id", text.haystack([c("source"), c("lang"), F.substring("text", 1, 4000)]).alias("hay"))
