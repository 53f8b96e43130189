"""From raw to canonical listings: one projection for each concern, and a reason beside every rejected row."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import dates, geo, rules, salary, text


@dataclass(frozen=True)
class Policy:
    relevance: rules.RelevancePack
    requirements: rules.RequirementPack
    categories: list[rules.Category] = field(default_factory=list)
    min_relevance: int = 25
    include_pathway: bool = True
    allow_remote: bool = True


def normalize(raw: DataFrame, places: DataFrame, policy: Policy, now: datetime) -> DataFrame:
    """Canonical columns and reject_reason (null for kept rows). The gates: title, relevance, pathway, least relevance, geography."""
    c = F.col
    rows = geo.locate(raw, "locationRaw", places)
    escaped = text.decode_escaped_html(c("description"))
    rows = rows.withColumn("_html", F.when(F.coalesce("descriptionIsHtml", F.lit(False)), escaped))
    rows = rows.withColumn("_text", F.when(c("_html").isNotNull(), text.html_to_text(c("_html"))).otherwise(text.stripped(F.coalesce("description", F.lit("")))))
    company = F.when(text.stripped(F.coalesce("company", F.lit(""))) == "", "Unknown employer").otherwise(text.stripped(c("company")))
    # what several columns use is a column of its own
    rows = rows.withColumns({
        "_company": company, "_title": text.clean_title(c("title")), "_class": rules.classify(c("title"), c("_text"), c("departmentRaw"), policy.relevance), "_posted": dates.parse_date(c("postedAt"), now),
        "_req": rules.extract_requirements(c("_text"), policy.requirements), "_pay": salary.parse_salary(F.coalesce(F.nullif("salaryRaw", F.lit("")), salary.find_salary(c("_text"))), c("_text")),
    })
    rows = rows.withColumn("_normal", text.normalize_cleaned(c("_title")))
    company = c("_company")
    where = F.concat_ws(" ", "title", "locationRaw", F.substring("_text", 1, 3000))
    remote = F.coalesce("remoteHint", F.lit(False)) | c("geo.isRemote")
    arrangement = F.when(geo.is_hybrid(where), "hybrid").when(remote, "remote").when(c("geo.city").isNotNull(), "onsite").otherwise("unknown")
    level = rules.experience_level(c("title"), c("_text"))
    expired = dates.is_expired(c("_posted"), now)
    age = (dates.micros(dates.instant(now)) - dates.micros(c("_posted"))) / dates.DAY
    placed = c("geo.isOntario") | (F.lit(policy.allow_remote) & remote & (c("geo.isCanada") | (F.coalesce("locationRaw", F.lit("")) == "") | c("geo.country").isNull()))
    reason = (
        F.when(text.stripped(F.coalesce("title", F.lit(""))) == "", "missing title")
        .when(c("_class.rejectReason").isNotNull(), c("_class.rejectReason"))
        .when(c("_class.isPathway") & F.lit(not policy.include_pathway), "pathway role")
        .when(c("_class.score") < policy.min_relevance, F.concat(F.lit("low relevance "), c("_class.score").cast("string")))
        .when(~placed, F.concat(F.lit("outside the region: "), F.coalesce("locationRaw", F.lit(""))))
    )
    categories = rules.categorize(c("title"), F.concat_ws("\n", "title", "departmentRaw", "_text"), c("_class.isPathway"), policy.categories)
    rank = rules.rank_score(c("_class.score"), age, c("_pay.min").isNotNull(), F.length("_text"), c("geo.isOntario"), remote & c("geo.isCanada"), expired, c("_class.isPathway"))
    at = dates.instant(now)
    return rows.select(
        text.listing_id(c("sourceId"), c("sourceJobId")).alias("id"), text.fingerprint_of(text.normalized_key(c("_normal")), company, c("geo.city"), remote).alias("fingerprint"), c("title").alias("titleRaw"), c("_title").alias("title"), c("_normal").alias("titleNormalized"),
        company.alias("company"), text.slugify(company).alias("companySlug"), "companyUrl", "locationRaw", c("geo.city").alias("city"), c("geo.region").alias("region"), c("geo.country").alias("country"), c("geo.isOntario").alias("isOntario"), c("geo.isCanada").alias("isCanada"),
        arrangement.alias("workArrangement"), level.alias("experienceLevel"), rules.employment_type(c("employmentTypeRaw"), c("title"), F.substring("_text", 1, 2000)).alias("employmentType"), categories["category"].alias("category"), categories["secondary"].alias("secondaryCategories"),
        c("_pay").alias("salary"), c("_req").alias("requirements"), c("_text").alias("description"), F.when(c("_html").isNotNull(), text.sanitize_html(c("_html"))).alias("descriptionHtml"), text.summarize(c("_text")).alias("summary"),
        c("_posted").alias("postedAt"), at.alias("firstSeenAt"), at.alias("lastSeenAt"), dates.expires_at(c("_posted")).alias("expiresAt"), expired.alias("isExpired"), F.lit(False).alias("isRepost"), F.lit(None).cast("string").alias("repostOf"),
        "sourceId", "sourceName", "sourceUrl", "applyUrl", c("_class.score").alias("relevanceScore"), c("_class.isPathway").alias("isPathwayRole"), rank.alias("rankScore"),
        text.keywords(F.concat_ws(" ", "title", company, "_text")).alias("keywords"), F.lit(1).alias("duplicateCount"), F.array().cast("array<struct<sourceName:string,url:string>>").alias("alsoPostedOn"), "_ord", reason.alias("reject_reason"),
    )


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.where("reject_reason is null").drop("reject_reason")
