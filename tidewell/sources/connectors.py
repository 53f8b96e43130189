"""Raw listings from landed payloads of job boards. Fetching stays outside Spark: payloads are rows of (token, label, payload, ord)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.dates import parse_age
from tidewell.operators.dedupe import first_wins
from tidewell.schema import RAW

HIDDEN_EMPLOYER = "Employer not disclosed"


@dataclass(frozen=True)
class Source:
    """id, display name, schema of a payload, path of its rows, fields of a listing from a row `j`, which rows count."""

    id: str
    name: str
    schema: str
    rows: str
    fields: Callable[[Callable[[str], Column]], dict[str, Column]]
    usable: Callable[[Callable[[str], Column]], Column]


def _joined(sep: str, *parts: Column) -> Column:
    """Parts that aren't empty, joined."""
    return F.array_join(F.filter(F.array(*(p.cast("string") for p in parts)), lambda p: F.coalesce(p, F.lit("")) != ""), sep)


def _listed(sep: str, items: Column) -> Column:
    return F.array_join(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")) != ""), sep)


def _full(*parts: Column) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*(F.nullif(p.cast("string"), F.lit("")) for p in parts))


def _own(id: Column) -> Column:
    return F.concat(F.col("token"), F.lit(":"), id.cast("string"))


def _says_remote(*parts: Column) -> Column:
    return F.when(F.concat_ws(" ", *parts).rlike("(?i)remote"), True)


def _named(prefix: str, label: Column) -> Column:
    return F.concat(F.lit(prefix + " · "), label)


def _greenhouse(j):
    place = F.coalesce(j("location.name"), _listed(" / ", F.transform(j("offices"), lambda o: F.coalesce(o["name"], o["location"]))), F.lit(""))
    return {
        "sourceJobId": _own(j("id")), "sourceName": _named("Greenhouse", F.col("label")), "sourceUrl": j("absolute_url"), "applyUrl": j("absolute_url"), "title": j("title"), "company": _full(j("company_name"), F.col("label")), "locationRaw": place,
        "description": j("content"), "descriptionIsHtml": F.lit(True), "postedAt": F.coalesce(j("first_published"), j("updated_at")), "departmentRaw": _listed(", ", F.transform(j("departments"), lambda d: d["name"])), "remoteHint": _says_remote(place),
    }


def _lever(j):
    place = _joined(" / ", j("categories.location"), _listed(" / ", j("categories.allLocations")))
    html = _joined("\n", j("description"), j("additional"))
    return {
        "sourceJobId": _own(j("id")), "sourceName": _named("Lever", F.col("label")), "sourceUrl": j("hostedUrl"), "applyUrl": _full(j("applyUrl"), j("hostedUrl")), "title": j("text"), "company": F.col("label"), "locationRaw": F.coalesce(_full(place, j("country")), F.lit("")),
        "description": F.coalesce(_full(html, j("descriptionPlain")), F.lit("")), "descriptionIsHtml": html != "", "postedAt": j("createdAt").cast("string"), "employmentTypeRaw": j("categories.commitment"),
        "departmentRaw": _full(_joined(", ", j("categories.team"), j("categories.department"))), "remoteHint": _says_remote(j("workplaceType"), place),
    }


def _ashby(j):
    place = _joined(" / ", j("location"), _listed(" / ", F.transform(j("secondaryLocations"), lambda s: s["location"])))
    pay = F.get(F.filter(j("compensation.summaryComponents"), lambda s: s["compensationType"].rlike("(?i)salary")), F.lit(0))
    per = F.coalesce(F.lower(F.regexp_replace(pay["interval"], r"(?i)^1\s*", "")), F.lit("year"))
    amount = F.concat(F.coalesce(pay["currencyCode"], F.lit("CAD")), F.lit(" "), pay["minValue"], F.coalesce(F.concat(F.lit(" - "), F.nullif(pay["maxValue"], F.lit("0"))), F.lit("")), F.lit(" per "), per)
    return {
        "sourceJobId": _own(j("id")), "sourceName": _named("Ashby", F.col("label")), "sourceUrl": _full(j("jobUrl"), j("applyUrl")), "applyUrl": _full(j("applyUrl"), j("jobUrl")), "title": j("title"), "company": F.col("label"), "locationRaw": place,
        "description": F.coalesce(j("descriptionHtml"), j("descriptionPlain"), F.lit("")), "descriptionIsHtml": F.coalesce(j("descriptionHtml"), F.lit("")) != "", "postedAt": j("publishedAt"), "employmentTypeRaw": j("employmentType"),
        "departmentRaw": _full(_joined(", ", j("department"), j("team"))), "salaryRaw": F.coalesce(_full(j("compensation.compensationTierSummary")), F.when(~F.coalesce(pay["minValue"], F.lit("")).isin("", "0"), amount)),
        "remoteHint": F.coalesce(j("isRemote"), F.concat_ws(" ", j("workplaceType"), place).rlike("(?i)remote")),
    }


def _workable(j):
    link = F.coalesce(j("url"), j("shortlink"), j("application_url"))
    name = _full(F.col("payload.name"), F.col("label"))
    return {
        "sourceJobId": _own(F.coalesce(j("shortcode"), j("id"))), "sourceName": _named("Workable", name), "sourceUrl": link, "applyUrl": F.coalesce(j("application_url"), link), "title": j("title"), "company": name,
        "locationRaw": _joined(", ", F.coalesce(j("city"), j("location.city")), F.coalesce(j("state"), j("location.region")), F.coalesce(j("country"), j("location.country"))), "description": _joined("\n", j("description"), j("requirements"), j("benefits")), "descriptionIsHtml": F.lit(True),
        "postedAt": F.coalesce(j("published_on"), j("created_at")), "employmentTypeRaw": j("employment_type"), "departmentRaw": j("department"), "remoteHint": F.coalesce(j("telecommuting"), F.coalesce(j("location.workplaceType"), F.lit("")).rlike("(?i)remote")),
    }


def _recruitee(j):
    link = F.coalesce(j("careers_url"), j("careers_apply_url"))
    return {
        "sourceJobId": _own(j("id")), "sourceName": _named("Recruitee", F.col("label")), "sourceUrl": link, "applyUrl": F.coalesce(j("careers_apply_url"), link), "title": j("title"), "company": F.col("label"), "locationRaw": F.coalesce(j("location"), _joined(", ", j("city"), j("state_name"), j("country_code"))),
        "description": _joined("\n", j("description"), j("requirements")), "descriptionIsHtml": F.lit(True), "postedAt": F.coalesce(j("published_at"), j("created_at")), "employmentTypeRaw": j("employment_type_code"), "departmentRaw": j("department"), "remoteHint": j("remote"),
    }


def _adzuna(j):
    whole = lambda v: F.floor(v + 0.5).cast("bigint").cast("string")
    pay = F.concat(F.lit("$"), whole(j("salary_min")), F.coalesce(F.concat(F.lit(" - $"), whole(F.nullif(j("salary_max"), F.lit(0.0)))), F.lit("")), F.lit(" per year"))
    return {
        "sourceJobId": j("id"), "sourceName": F.lit("Adzuna"), "sourceUrl": j("redirect_url"), "applyUrl": j("redirect_url"), "title": F.regexp_replace(j("title"), "</?[^>]+>", ""), "company": F.coalesce(j("company.display_name"), F.lit(HIDDEN_EMPLOYER)),
        "locationRaw": F.coalesce(j("location.display_name"), F.array_join(j("location.area"), ", "), F.lit("")), "description": j("description"), "descriptionIsHtml": F.lit(False), "postedAt": j("created"), "employmentTypeRaw": _joined(" ", j("contract_time"), j("contract_type")),
        "salaryRaw": F.when((F.coalesce(j("salary_is_predicted"), F.lit("")) != "1") & (F.coalesce(j("salary_min"), F.lit(0.0)) != 0), pay), "departmentRaw": j("category.label"),
    }


def _jooble(j):
    return {
        "sourceJobId": F.coalesce(j("id"), j("link")), "sourceName": F.concat(F.lit("Jooble"), F.coalesce(F.concat(F.lit(" · "), _full(j("source"))), F.lit(""))), "sourceUrl": j("link"), "applyUrl": j("link"), "title": j("title"), "company": F.coalesce(_full(j("company")), F.lit(HIDDEN_EMPLOYER)),
        "locationRaw": F.coalesce(j("location"), F.lit("Ontario, Canada")), "description": j("snippet"), "descriptionIsHtml": F.lit(True), "postedAt": j("updated"), "salaryRaw": _full(j("salary")), "employmentTypeRaw": j("type"),
    }


def _arbeitnow(j):
    page = F.concat(F.lit("https://www.arbeitnow.com/view/"), j("slug"))
    return {
        "sourceJobId": j("slug"), "sourceName": F.lit("Arbeitnow"), "sourceUrl": page, "applyUrl": _full(j("url"), page), "title": j("title"), "company": F.coalesce(j("company_name"), F.lit(HIDDEN_EMPLOYER)), "locationRaw": F.coalesce(j("location"), F.when(j("remote"), "Remote"), F.lit("")),
        "description": j("description"), "descriptionIsHtml": F.lit(True), "postedAt": j("created_at"), "employmentTypeRaw": _listed(", ", j("job_types")), "remoteHint": j("remote"), "departmentRaw": _listed(", ", j("tags")),
    }


def _smartrecruiters(j):
    sections = F.transform(F.map_values(F.coalesce(j("jobAd.sections"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<title:string,text:string>>")))), lambda s: F.concat(F.lit("<h3>"), F.coalesce(s["title"], F.lit("")), F.lit("</h3>"), F.coalesce(s["text"], F.lit(""))))
    link = F.coalesce(j("applyUrl"), j("postingUrl"), F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("token"), F.lit("/"), j("id")))
    company = F.coalesce(j("company.name"), F.col("label"))
    return {
        "sourceJobId": _own(j("id")), "sourceName": _named("SmartRecruiters", company), "sourceUrl": link, "applyUrl": link, "title": j("name"), "company": company, "locationRaw": _joined(", ", j("location.city"), j("location.region"), j("location.country")),
        "description": F.array_join(sections, "\n"), "descriptionIsHtml": F.lit(True), "postedAt": j("releasedDate"), "employmentTypeRaw": j("typeOfEmployment.label"), "departmentRaw": j("department.label"), "remoteHint": j("location.remote"),
    }


def _remotive(j):
    return {
        "sourceJobId": j("id"), "sourceName": F.lit("Remotive"), "sourceUrl": j("url"), "applyUrl": j("url"), "title": j("title"), "company": F.coalesce(j("company_name"), F.lit(HIDDEN_EMPLOYER)), "locationRaw": F.coalesce(j("candidate_required_location"), F.lit("Remote")),
        "description": j("description"), "descriptionIsHtml": F.lit(True), "postedAt": j("publication_date"), "employmentTypeRaw": j("job_type"), "salaryRaw": _full(j("salary")), "departmentRaw": j("category"), "remoteHint": F.lit(True),
    }


def _workday(j):
    """The token is tenant@host/site, with #hint after it where the tenant has a place of its own."""
    token = F.col("token")
    tenant, rest = F.split_part(token, F.lit("@"), F.lit(1)), F.split_part(token, F.lit("@"), F.lit(2))
    page = F.concat(F.lit("https://"), F.split_part(rest, F.lit("#"), F.lit(1)), j("externalPath"))
    return {
        "sourceJobId": F.concat(tenant, F.lit(":"), j("externalPath")),
        "sourceName": _named("Workday", F.col("label")),
        "sourceUrl": page,
        "applyUrl": page,
        "title": j("title"),
        "company": F.regexp_replace(F.col("label"), r"\s*\(.*\)$", ""),
        "locationRaw": F.coalesce(j("locationsText"), F.split_part(rest, F.lit("#"), F.lit(2)), F.lit("")),
        "description": F.array_join(F.coalesce(j("bulletFields"), F.array().cast("array<string>")), " · "),
        "descriptionIsHtml": F.lit(False),
        "postedAt": F.coalesce(j("postedOn"), j("startDate")),
        "remoteHint": _says_remote(j("locationsText")),
    }


_has = lambda *names: lambda j: reduce(lambda a, b: a & b, (F.coalesce(j(n).cast("string"), F.lit("")) != "" for n in names))

SOURCES = [
    Source("greenhouse", "Greenhouse", "jobs array<struct<id:string,title:string,absolute_url:string,company_name:string,location:struct<name:string>,offices:array<struct<name:string,location:string>>,content:string,first_published:string,updated_at:string,departments:array<struct<name:string>>>>", "jobs", _greenhouse, _has("title", "absolute_url")),
    Source("lever", "Lever", "rows array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,categories:struct<location:string,allLocations:array<string>,commitment:string,team:string,department:string>,country:string,description:string,additional:string,descriptionPlain:string,createdAt:bigint,workplaceType:string>>", "rows", _lever, _has("text", "hostedUrl")),
    Source("ashby", "Ashby", "jobs array<struct<id:string,title:string,isListed:boolean,jobUrl:string,applyUrl:string,location:string,secondaryLocations:array<struct<location:string>>,descriptionHtml:string,descriptionPlain:string,publishedAt:string,employmentType:string,department:string,team:string,isRemote:boolean,workplaceType:string,compensation:struct<compensationTierSummary:string,summaryComponents:array<struct<compensationType:string,minValue:string,maxValue:string,currencyCode:string,interval:string>>>>>", "jobs", _ashby, lambda j: _has("title")(j) & F.coalesce(j("isListed"), F.lit(True)) & (F.coalesce(_full(j("jobUrl"), j("applyUrl")), F.lit("")) != "")),
    Source("workable", "Workable", "name string, jobs array<struct<id:string,shortcode:string,title:string,url:string,shortlink:string,application_url:string,city:string,state:string,country:string,location:struct<city:string,region:string,country:string,workplaceType:string>,description:string,requirements:string,benefits:string,published_on:string,created_at:string,employment_type:string,department:string,telecommuting:boolean>>", "jobs", _workable, lambda j: _has("title")(j) & F.coalesce(j("shortcode"), j("id")).isNotNull() & F.coalesce(j("url"), j("shortlink"), j("application_url")).isNotNull()),
    Source("recruitee", "Recruitee", "offers array<struct<id:string,title:string,careers_url:string,careers_apply_url:string,location:string,city:string,state_name:string,country_code:string,description:string,requirements:string,published_at:string,created_at:string,employment_type_code:string,department:string,remote:boolean>>", "offers", _recruitee, lambda j: _has("title")(j) & F.coalesce(j("careers_url"), j("careers_apply_url")).isNotNull()),
    Source("workday", "Workday", "jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,startDate:string,bulletFields:array<string>>>", "jobPostings", _workday, _has("title", "externalPath")),
    Source("adzuna", "Adzuna", "results array<struct<id:string,title:string,redirect_url:string,salary_is_predicted:string,salary_min:double,salary_max:double,company:struct<display_name:string>,location:struct<display_name:string,area:array<string>>,description:string,created:string,contract_time:string,contract_type:string,category:struct<label:string>>>", "results", _adzuna, _has("title", "redirect_url")),
    Source("jooble", "Jooble", "jobs array<struct<id:string,title:string,link:string,source:string,company:string,location:string,snippet:string,updated:string,salary:string,type:string>>", "jobs", _jooble, _has("title", "link")),
    Source("arbeitnow", "Arbeitnow", "data array<struct<slug:string,title:string,url:string,company_name:string,location:string,remote:boolean,description:string,created_at:string,job_types:array<string>,tags:array<string>>>", "data", _arbeitnow, _has("title", "slug")),
    Source("smartrecruiters", "SmartRecruiters", "content array<struct<id:string,name:string,company:struct<name:string>,location:struct<city:string,region:string,country:string,remote:boolean>,releasedDate:string,typeOfEmployment:struct<label:string>,department:struct<label:string>,applyUrl:string,postingUrl:string,jobAd:struct<sections:map<string,struct<title:string,text:string>>>>>", "content", _smartrecruiters, _has("name")),
    Source("remotive", "Remotive", "jobs array<struct<id:string,title:string,url:string,company_name:string,candidate_required_location:string,description:string,publication_date:string,job_type:string,salary:string,category:string>>", "jobs", _remotive, _has("title", "url")),
]


def source_by_id(id: str) -> Source | None:
    return next((s for s in SOURCES if s.id == id), None)


def enabled_sources(only: list[str] = (), disabled: list[str] = ()) -> list[Source]:
    """In their fixed order; the deny list beats the allow list; case doesn't count."""
    yes, no = {x.lower() for x in only}, {x.lower() for x in disabled}
    return [s for s in SOURCES if s.id not in no and (not yes or s.id in yes)]


def raw_columns(fields: dict[str, Column], source: str) -> list[Column]:
    fields = {"sourceId": F.lit(source), **fields}
    out = []
    for part in RAW.replace("map<string,string>", "map<string;string>").split(", "):
        name, kind = part.split(" ", 1)
        kind = kind.replace(";", ",")
        out.append((F.col("_ord") if name == "_ord" else fields.get(name, F.lit(None)).cast(kind)).alias(name))
    return out


def read_payloads(payloads: DataFrame, source: Source) -> DataFrame:
    """Raw listings of one source, the first of each sourceJobId. payloads: token, label, payload (JSON text), ord. A payload that doesn't parse has no rows."""
    kind = f"struct<{', '.join(p.replace(' ', ':', 1) for p in _top(source.schema))}>"
    text = F.when(F.ltrim("payload").startswith("["), F.concat(F.lit('{"' + source.rows + '":'), F.col("payload"), F.lit("}"))).otherwise(F.col("payload"))
    parsed = payloads.withColumn("payload", F.from_json(text, kind)).select("token", "label", "ord", "payload", F.posexplode(F.col(f"payload.{source.rows}")).alias("nth", "j"))
    j = lambda path: F.col(f"j.{path}")
    rows = parsed.where(source.usable(j)).withColumn("_ord", F.col("ord") * 1_000_000 + F.col("nth"))
    return first_wins(rows.select(*raw_columns(source.fields(j), source.id)), ["sourceId", "sourceJobId"], ["_ord"])


WORKDAY_DETAIL = "jobPostingInfo struct<jobDescription:string,location:string,additionalLocations:array<string>,postedOn:string,startDate:string,timeType:string,externalUrl:string,remoteType:string>"
#: Details are fetched for this many postings of a run at most (fixed value).
WORKDAY_DETAILS = 60


def workday_targets(rows: DataFrame, terms: list[str], most: int = WORKDAY_DETAILS) -> DataFrame:
    """sourceJobId, detail_url of the first `most` postings whose title has the first word of a term."""
    tenant, path = F.split_part("sourceJobId", F.lit(":"), F.lit(1)), F.regexp_replace("sourceJobId", "^[^:]*:", "")
    board = F.substring("sourceUrl", F.lit(1), F.length("sourceUrl") - F.length(path))
    url = F.concat(F.regexp_extract(board, "^https://[^/]*", 0), F.lit("/wday/cxs/"), tenant, F.lit("/"), F.regexp_replace(board, "^https://[^/]*/", ""), path)
    words = list(dict.fromkeys(t.lower().split()[0] for t in terms if t.strip()))
    wanted = reduce(lambda a, b: a | b, (F.lower("title").contains(w) for w in words), F.lit(False))
    return rows.where(wanted).orderBy("_ord").limit(most).select("sourceJobId", url.alias("detail_url"))


def read_workday(pages: DataFrame, now: datetime, details: DataFrame | None = None) -> DataFrame:
    """Raw listings of Workday's result pages, with the details that were landed for some: details has sourceJobId, payload (JSON text), ord.

    A posting's details decide where they say something; of several for one posting the first that parses counts.
    """
    said = lambda t: F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rows = read_payloads(pages, source_by_id("workday")).withColumn("postedAt", said(parse_age(F.col("postedAt"), now)))
    if details is None:
        return rows
    kind = f"struct<{WORKDAY_DETAIL.replace(' ', ':', 1)}>"
    info = details.select(F.col("sourceJobId").alias("_id"), "ord", F.from_json("payload", kind)["jobPostingInfo"].alias("_d")).where(F.col("_d").isNotNull())
    info = info.groupBy("_id").agg(F.min_by("_d", "ord").alias("_d"))
    d = F.col("_d")
    places = _listed(" / ", F.concat(F.array(d["location"]), F.coalesce(d["additionalLocations"], F.array().cast("array<string>"))))
    has = lambda x: F.coalesce(x, F.lit("")) != ""
    better = {
        "description": F.when(has(d["jobDescription"]), d["jobDescription"]).otherwise(F.col("description")),
        "descriptionIsHtml": F.when(has(d["jobDescription"]), True).otherwise(F.col("descriptionIsHtml")),
        "locationRaw": F.when(has(d["location"]), places).otherwise(F.col("locationRaw")),
        "postedAt": F.coalesce(said(parse_age(F.coalesce(d["postedOn"], d["startDate"]), now)), F.col("postedAt")),
        "employmentTypeRaw": F.coalesce(d["timeType"], F.col("employmentTypeRaw")),
        "remoteHint": F.when(has(d["remoteType"]), d["remoteType"].rlike("(?i)remote")).otherwise(F.col("remoteHint")),
        "applyUrl": F.when(has(d["externalUrl"]), d["externalUrl"]).otherwise(F.col("applyUrl")),
    }
    return rows.join(info, F.col("sourceJobId") == F.col("_id"), "left").withColumns(better).select(*rows.columns)


def _top(schema: str) -> list[str]:
    """Top-level fields of a schema string."""
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


# ---- result pages and feeds ----


def read_result_pages(pages: DataFrame, origin: str = "", source: str = "jobbank", name: str = "Job Bank") -> DataFrame:
    """Raw listings from HTML result pages (html, ord): an article with a link to a posting is one."""
    articles = pages.select("ord", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<article\b[^>]*>.*?</article>"), F.lit(0))).alias("nth", "a"))
    a = F.col("a")
    href = F.regexp_extract(a, r"""(?is)<a\b[^>]*href\s*=\s*["']([^"']*/jobsearch/jobposting/\d+[^"']*)["']""", 1)
    hidden = F.regexp_replace(a, r"(?is)<(\w+)\b[^>]*class\s*=\s*[\"'][^\"']*\b(?:hidden|wb-inv|sr-only)\b[^\"']*[\"'][^>]*>.*?</\1>", "")
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))
    part = lambda tag, cls: bare(F.regexp_extract(hidden, rf"(?is)<({tag})\b[^>]*class\s*=\s*[\"'][^\"']*\b{cls}\b[^\"']*[\"'][^>]*>(.*?)</\1>", 2))
    title = F.regexp_replace(_full(part(r"\w+", "noctitle"), bare(F.regexp_extract(hidden, r"(?is)<h3\b[^>]*>(.*?)</h3>", 1)), bare(F.regexp_extract(hidden, r"(?is)<a\b[^>]*jobposting[^>]*>(.*?)</a>", 1))), r"^\s*\d+\s*", "")
    path = F.split_part(href, F.lit("?"), F.lit(1))
    url = F.when(path.startswith("http"), path).otherwise(F.concat(F.lit(origin), path))
    less = lambda x, prefix: F.regexp_replace(x, rf"(?i)^{prefix}\s*", "")
    snippet = F.array_join(F.filter(F.transform(F.regexp_extract_all(a, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1)), bare), lambda x: x != ""), " · ")
    company, place = F.coalesce(_full(part(r"\w+", "business")), F.lit(HIDDEN_EMPLOYER)), F.coalesce(_full(part(r"\w+", "location")), F.lit("Ontario, Canada"))
    fields = {
        "sourceJobId": F.regexp_extract(href, r"/jobposting/(\d+)", 1), "sourceName": F.lit(name), "sourceUrl": url, "applyUrl": url, "title": title, "company": less(company, "Employer:"), "locationRaw": less(place, "Location:"), "description": snippet, "descriptionIsHtml": F.lit(False),
        "postedAt": _full(less(part(r"\w+", "date"), "Posted on")), "salaryRaw": _full(less(part(r"\w+", "salary"), "Salary:")), "remoteHint": F.when(F.concat_ws(" ", title, place, snippet).rlike(r"(?iu)remote|t[eé]l[eé]travail"), True),
    }
    rows = articles.where(href != "").withColumn("_ord", F.col("ord") * 1_000_000 + F.col("nth"))
    return first_wins(rows.select(*raw_columns(fields, source)).where(F.coalesce("title", F.lit("")) != ""), ["sourceId", "sourceJobId"], ["_ord"])


def read_feeds(feeds: DataFrame, source: str = "jobbank", name: str = "Job Bank") -> DataFrame:
    """Raw listings from Atom feeds (xml, ord); labelled fields are in the summary."""
    entries = feeds.select("ord", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<entry\b[^>]*>.*?</entry>"), F.lit(0))).alias("nth", "e"))
    tag = lambda t: F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?s)<{t}\b[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{t}>", 1), r"\s+", " "))
    plain = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    summary = plain(tag("summary"))
    field = lambda label: _full(F.trim(F.regexp_extract(summary, rf"(?i)<strong>\s*{label}\s*:?\s*</strong>\s*([^<]*)", 1)))
    href = F.coalesce(_full(F.regexp_extract("e", r"""<link\b[^>]*href\s*=\s*["']([^"']*)["']""", 1)), tag("id"))
    url, title, place = F.split_part(href, F.lit("?"), F.lit(1)), plain(tag("title")), field("Location")
    fields = {
        "sourceJobId": F.regexp_extract(href, r"/jobposting/(\d+)", 1), "sourceName": F.lit(name), "sourceUrl": url, "applyUrl": url, "title": title, "company": F.coalesce(field("Employer"), F.lit(HIDDEN_EMPLOYER)),
        "locationRaw": F.when(F.coalesce(place, F.lit("Not Available")) != "Not Available", place).otherwise("Ontario, Canada"), "description": F.trim(F.regexp_replace(F.regexp_replace(summary, "<[^>]+>", " "), r"\s+", " ")), "descriptionIsHtml": F.lit(False),
        "postedAt": _full(tag("updated")), "salaryRaw": field("Salary"), "remoteHint": F.when(F.concat_ws(" ", title, place).rlike(r"(?iu)remote|t[eé]l[eé]travail"), True),
    }
    rows = entries.withColumn("_ord", F.col("ord") * 1_000_000 + F.col("nth")).select(*raw_columns(fields, source))
    return first_wins(rows.where((F.col("sourceJobId") != "") & (F.col("title") != "")), ["sourceId", "sourceJobId"], ["_ord"])


def rotated(terms: DataFrame, hour: int, most: int) -> DataFrame:
    """The `most` terms of an hour, from a rotation over all (term, ord)."""
    n = terms.count()
    return terms.withColumn("turn", F.pmod(F.col("ord") - hour % max(n, 1), F.lit(max(n, 1)))).where(F.col("turn") < most)


def with_extra_boards(base: DataFrame, extra: list[str]) -> DataFrame:
    """Boards (token, label) and an operator's own tokens, which label themselves; case doesn't count."""
    tokens = base.sparkSession.createDataFrame([(t, t) for t in dict.fromkeys(x.strip() for x in extra) if t], "token string, label string")
    more = first_wins(tokens.withColumn("_low", F.lower("token")), ["_low"], ["token"])
    return base.unionByName(more.join(base.select(F.lower("token").alias("_low")), "_low", "left_anti").drop("_low"))
