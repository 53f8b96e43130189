"""Connectors over landed payloads: tables are landed as boards' payloads, read by the data source, and become raw listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.scratch import new_folder
from tidewell.sources import connectors, payloads

from . import query

c = F.col


def _landed(rows: DataFrame, label: str) -> DataFrame:
    """Lands (token, label, payload) as one run and reads it back."""
    spark = rows.sparkSession
    payloads.register(spark)
    folder = new_folder(spark, label)
    rows.write.option("ignoreNullFields", "false").json(f"{folder}/run=1")
    return spark.read.format(payloads.FORMAT).option("path", folder).option("form", "rows").load()


def _boards(t, name: str, job, wrap: str) -> DataFrame:
    """Parts as a board's payloads, 25 postings each; wrap names the payload's list ('' if the payload is the list)."""
    board = F.concat(F.lit("b"), F.floor(c("p_partkey") / 25).cast("string"))
    jobs = t("part").groupBy(board.alias("token")).agg(F.collect_list(job).alias("jobs"))
    payload = F.to_json(F.struct(c("jobs").alias(wrap)) if wrap else c("jobs"))
    rows = _landed(jobs.select("token", F.concat(F.lit("Board "), "token").alias("label"), payload.alias("payload")), f"landing-{name}")
    found = connectors.read_payloads(rows, connectors.source_by_id(name))
    return found.select("sourceId", "sourceJobId", "sourceName", "title", "company", "locationRaw", "description", "descriptionIsHtml", "postedAt", "salaryRaw", "departmentRaw", "remoteHint")


def _url():
    return F.concat(F.lit("https://board.example/"), c("p_partkey"))


def _greenhouse(t):
    place = F.when(c("p_size") < 10, F.struct(F.concat(F.lit("Remote, "), "p_brand").alias("name")))
    job = F.struct(
        c("p_partkey").cast("string").alias("id"), c("p_name").alias("title"), _url().alias("absolute_url"), F.when(c("p_size") % 2 == 0, c("p_brand")).alias("company_name"),
        place.alias("location"), F.array(F.struct(c("p_brand").alias("name")), F.struct(c("p_type").alias("name"))).alias("offices"), c("p_type").alias("content"), F.lit("2024-05-01").alias("updated_at"), F.array(F.struct(c("p_type").alias("name"))).alias("departments"))
    return _boards(t, "greenhouse", job, "jobs")


def _lever(t):
    places = F.struct(c("p_brand").alias("location"), F.lit("Hardware").alias("team"), c("p_type").alias("department"))
    job = F.struct(c("p_partkey").cast("string").alias("id"), c("p_name").alias("text"), _url().alias("hostedUrl"), (c("p_partkey") + 1_700_000_000_000).alias("createdAt"), places.alias("categories"), c("p_name").alias("descriptionPlain"),
                   F.when(c("p_size") > 40, F.lit("remote")).alias("workplaceType"))
    return _boards(t, "lever", job, "")


def _smartrecruiters(t):
    section = F.create_map(F.lit("main"), F.struct(F.lit("About").alias("title"), c("p_name").alias("text")))
    job = F.struct(c("p_partkey").cast("string").alias("id"), c("p_name").alias("name"), F.struct(c("p_brand").alias("city"), F.lit("").alias("region"), F.lit("ca").alias("country"), (c("p_size") > 25).alias("remote")).alias("location"), F.lit("2024-05-02").alias("releasedDate"),
                   F.struct(c("p_type").alias("label")).alias("department"), F.struct(section.alias("sections")).alias("jobAd"), _url().alias("postingUrl"))
    return _boards(t, "smartrecruiters", job, "content")


def _adzuna(t):
    job = F.struct(
        c("p_partkey").cast("string").alias("id"), F.concat(F.lit("<strong>"), "p_name", F.lit("</strong>")).alias("title"), _url().alias("redirect_url"), F.when(c("p_size") % 5 == 0, "1").otherwise("0").alias("salary_is_predicted"),
        c("p_retailprice").alias("salary_min"), F.when(c("p_size") % 2 == 0, c("p_retailprice") * 2).alias("salary_max"), F.struct(F.array(c("p_brand"), c("p_type")).alias("area")).alias("location"), c("p_type").alias("description"), F.lit("2024-05-03").alias("created"))
    return _boards(t, "adzuna", job, "results")


_COLUMNS = """'{id}' AS sourceId, {key} AS sourceJobId, {name} AS sourceName, p_name AS title, {company} AS company, {place} AS locationRaw, {body} AS description,
  {html} AS descriptionIsHtml, {posted} AS postedAt, {pay} AS salaryRaw, {team} AS departmentRaw, {remote} AS remoteHint"""
_TOKEN = "'b' || (p_partkey // 25)"
_BOARD = f"'Board ' || {_TOKEN}"
_HALF_UP = "CAST(CAST(floor({} + 0.5) AS BIGINT) AS VARCHAR)"
_SQL = {
    "greenhouse": dict(
        key=f"{_TOKEN} || ':' || p_partkey", name=f"'Greenhouse · ' || {_BOARD}", company=f"CASE WHEN p_size % 2 = 0 THEN p_brand ELSE {_BOARD} END", place="CASE WHEN p_size < 10 THEN 'Remote, ' || p_brand ELSE p_brand || ' / ' || p_type END", body="p_type", html="true",
        posted="'2024-05-01'", pay="NULL", team="p_type", remote="CASE WHEN p_size < 10 THEN true END"),
    "lever": dict(
        key=f"{_TOKEN} || ':' || p_partkey", name=f"'Lever · ' || {_BOARD}", company=_BOARD, place="p_brand", body="p_name", html="false", posted="CAST(p_partkey + 1700000000000 AS VARCHAR)", pay="NULL", team="'Hardware, ' || p_type", remote="CASE WHEN p_size > 40 THEN true END"),
    "smartrecruiters": dict(
        key=f"{_TOKEN} || ':' || p_partkey", name=f"'SmartRecruiters · ' || {_BOARD}", company=_BOARD, place="p_brand || ', ca'", body="'<h3>About</h3>' || p_name", html="true", posted="'2024-05-02'", pay="NULL", team="p_type", remote="p_size > 25"),
    "adzuna": dict(
        key="CAST(p_partkey AS VARCHAR)", name="'Adzuna'", company="'Employer not disclosed'", place="p_brand || ', ' || p_type", body="p_type", html="false", posted="'2024-05-03'",
        pay=f"CASE WHEN p_size % 5 <> 0 THEN '$' || {_HALF_UP.format('p_retailprice')} || CASE WHEN p_size % 2 = 0 THEN ' - $' || {_HALF_UP.format('p_retailprice * 2')} ELSE '' END || ' per year' END", team="NULL", remote="NULL"),
}


@query(" UNION ALL ".join(f"SELECT {_COLUMNS.format(id=k, **v)} FROM part" for k, v in _SQL.items()))
def landed_boards(t):
    return reduce(DataFrame.unionByName, (f(t) for f in (_greenhouse, _lever, _smartrecruiters, _adzuna)))


_TITLE = r"regexp_extract(html, '<article><h1>(.*?)</h1>', 1, 's')"
_BARE = r"trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""
SELECT CAST(page_id AS VARCHAR) AS sourceJobId, regexp_replace({_BARE.format(_TITLE)}, '^\s*\d+\s*', '') AS title,
  'https://jobs.example/jobsearch/jobposting/' || page_id AS sourceUrl, split_part(split_part(url, '://', 2), '/', 1) AS company, 'Ontario, Canada' AS locationRaw
FROM pages WHERE regexp_replace({_BARE.format(_TITLE)}, '^\s*\d+\s*', '') <> ''
""")
def landed_pages(t):
    """Web pages as result pages: each article links to a posting, its heading is the title, its host the employer."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    head = F.concat(F.lit('<article><a href="/jobsearch/jobposting/'), c("page_id"), F.lit('?source=x">go</a><span class="business">Employer: '), host, F.lit('</span><span class="noctitle">'))
    html = F.regexp_replace("html", "(?s)<article><h1>(.*?)</h1>", "<article>$1</span>")
    page = F.replace(html, F.lit("<article>"), head)
    rows = _landed(t("pages").select(c("page_id").cast("string").alias("token"), host.alias("label"), page.alias("payload")), "landing-pages")
    found = connectors.read_result_pages(rows.select(c("payload").alias("html"), "ord"), "https://jobs.example")
    return found.select("sourceJobId", "title", "sourceUrl", "company", "locationRaw")
