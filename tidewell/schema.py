"""Schemas of raw and canonical listings."""

from __future__ import annotations

RAW = (
    "sourceJobId string, sourceId string, sourceName string, sourceUrl string, applyUrl string, title string, company string, companyUrl string, locationRaw string, description string, descriptionIsHtml boolean, "
    "postedAt string, employmentTypeRaw string, salaryRaw string, departmentRaw string, remoteHint boolean, extra map<string,string>, _ord bigint"
)
SALARY = "struct<min:double,max:double,currency:string,period:string,annualMin:bigint,annualMax:bigint,raw:string>"
REQUIREMENTS = "struct<requiredSkills:array<string>,preferredSkills:array<string>,technologies:array<string>,certifications:array<string>,education:array<string>,yearsExperience:string,yearsExperienceMin:int>"
LISTING = (
    "id string, fingerprint string, titleRaw string, title string, titleNormalized string, company string, companySlug string, companyUrl string, locationRaw string, city string, region string, country string, "
    "isOntario boolean, isCanada boolean, workArrangement string, experienceLevel string, employmentType string, category string, secondaryCategories array<string>, "
    f"salary {SALARY}, requirements {REQUIREMENTS}, description string, descriptionHtml string, summary string, postedAt timestamp, firstSeenAt timestamp, lastSeenAt timestamp, expiresAt timestamp, "
    "isExpired boolean, isRepost boolean, repostOf string, sourceId string, sourceName string, sourceUrl string, applyUrl string, relevanceScore int, isPathwayRole boolean, rankScore int, "
    "keywords array<string>, duplicateCount int, alsoPostedOn array<struct<sourceName:string,url:string>>, _ord bigint"
)
#: Display order and labels of levels, and labels of work arrangements (fixed values).
LEVELS = ["internship", "coop", "entry", "junior", "mid", "senior", "lead", "manager", "director", "executive", "unknown"]
ARRANGEMENTS = {"remote": "Remote", "hybrid": "Hybrid", "onsite": "On-site", "unknown": "Not specified"}
ENTRY_FRIENDLY = ["internship", "coop", "entry", "junior"]
