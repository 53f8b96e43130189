"""Typed filters over listings: a dataclass, its URL form, and its predicate."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from urllib.parse import parse_qsl, quote, unquote, urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.dates import DAY, instant, micros

SORTS = ("relevance", "newest", "oldest", "salary", "company")
#: URL keys of list-valued, whole-number and yes-or-no filters (fixed values).
LIST_KEYS = {"experience": "experience", "category": "categories", "arrangement": "arrangement", "employment": "employment", "city": "cities", "company": "companies", "skill": "skills", "cert": "certifications", "source": "sources"}
INT_KEYS = {"within": "posted_within_days", "salaryMin": "salary_min", "page": "page", "pageSize": "page_size"}
BOOL_KEYS = {"hasSalary": "has_salary", "includeExpired": "include_expired", "includePathway": "include_pathway", "onlyPathway": "only_pathway"}
TEXT_KEYS = {"q": "q", "from": "posted_from", "to": "posted_to", "sort": "sort"}


@dataclass(frozen=True)
class Filters:
    q: str | None = None
    experience: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    arrangement: list[str] = field(default_factory=list)
    employment: list[str] = field(default_factory=list)
    cities: list[str] = field(default_factory=list)
    companies: list[str] = field(default_factory=list)
    skills: list[str] = field(default_factory=list)
    certifications: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    posted_within_days: int | None = None
    posted_from: str | None = None
    posted_to: str | None = None
    salary_min: int | None = None
    has_salary: bool | None = None
    include_expired: bool | None = None
    include_pathway: bool | None = None
    only_pathway: bool | None = None
    sort: str = "relevance"
    page: int = 1
    page_size: int = 25

    def active(self) -> int:
        """How many filters are set."""
        flags = [self.posted_within_days, self.posted_from, self.posted_to, self.salary_min, self.has_salary, self.include_expired, self.only_pathway, self.include_pathway is False]
        return sum(len(getattr(self, f)) for f in LIST_KEYS.values()) + sum(map(bool, flags))

    @classmethod
    def from_query(cls, query: str) -> Filters:
        """From a URL's query string; what doesn't parse is left at its default. Commas inside values are percent-encoded."""
        raw = {}
        for pair in query.lstrip("?").split("&"):
            key, _, value = pair.partition("=")
            if key and unquote(key) not in raw:
                raw[unquote(key)] = value.replace("+", " ")
        out = cls()
        for key, value in raw.items():
            plain = unquote(value)
            if key in LIST_KEYS:
                # a literal comma separates values, an encoded one belongs to its value
                parts = [unquote(unquote(x)).strip() for x in value.replace("%2C", ",").replace("%2c", ",").split(",")]
                out = replace(out, **{LIST_KEYS[key]: [x for x in parts if x]})
            elif key in INT_KEYS and (n := _leading_int(plain)) is not None:
                out = replace(out, **{INT_KEYS[key]: n})
            elif key in BOOL_KEYS:
                out = replace(out, **{BOOL_KEYS[key]: plain.lower() in ("1", "true", "yes")})
            elif key in TEXT_KEYS and plain:
                out = replace(out, **{TEXT_KEYS[key]: plain})
        return out

    def to_query(self) -> str:
        """The inverse of from_query; defaults are left out."""
        out = []
        if self.q:
            out.append(("q", self.q))
        out += [(k, ",".join(quote(x, safe="") if "," in x or "%" in x else x for x in getattr(self, f))) for k, f in LIST_KEYS.items() if getattr(self, f)]
        out += [(k, str(getattr(self, f))) for k, f in (("within", "posted_within_days"), ("from", "posted_from"), ("to", "posted_to"), ("salaryMin", "salary_min")) if getattr(self, f)]
        out += [(k, "1") for k in ("hasSalary", "includeExpired", "onlyPathway") if getattr(self, BOOL_KEYS[k])]
        if self.include_pathway is False:
            out.append(("includePathway", "0"))
        out += [(k, str(v)) for k, v, d in (("sort", self.sort, "relevance"), ("page", self.page, 1), ("pageSize", self.page_size, 25)) if v and v != d and (k != "page" or v > 1)]
        return urlencode(out)


def _leading_int(x: str) -> int | None:
    x = x.strip()
    sign, digits = (x[0], x[1:]) if x[:1] in ("+", "-") else ("", x)
    n = len(digits) - len(digits.lstrip("0123456789"))
    return int(sign + digits[:n]) if n else None


def query_pairs(query: str) -> list[tuple[str, str]]:
    return parse_qsl(query)


def in_list(value: Column, wanted: list[str]) -> Column:
    """True for any value if nothing is wanted in particular."""
    return value.isin(wanted) if wanted else F.lit(True)


def any_of(values: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(values, F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(True)


def all_of(values: Column, wanted: list[str]) -> Column:
    """Every wanted value is there; case doesn't count."""
    return F.size(F.array_except(F.array(*(F.lit(x.lower()) for x in wanted)), F.transform(values, F.lower))) == 0 if wanted else F.lit(True)


def category_match(primary: Column, secondary: Column, wanted: list[str]) -> Column:
    return in_list(primary, wanted) | any_of(secondary, wanted) if wanted else F.lit(True)


def city_label(city: Column, remote: Column, missing: str = "Other", away: str = "Remote") -> Column:
    return F.coalesce(city, F.when(remote, away).otherwise(missing))


def salary_floor(annual_min: Column, annual_max: Column, least: float | None) -> Column:
    return F.coalesce(F.coalesce(annual_max, annual_min) >= least, F.lit(False)) if least and least > 0 else F.lit(True)


def posted_within(posted: Column, days: float | None, now: datetime) -> Column:
    """Age in days, fractions counted; null dates fail, future ones pass."""
    return F.coalesce((micros(instant(now)) - micros(posted)) / DAY <= days, F.lit(False)) if days and days > 0 else F.lit(True)


def posted_between(posted: Column, first: str | None, last: str | None) -> Column:
    """From the first instant to a day after the last, both included; bounds that don't parse are ignored."""
    out = F.lit(True)
    for bound, add, above in ((first, timedelta(0), True), (last, timedelta(days=1), False)):
        try:
            at = datetime.fromisoformat(bound) + add if bound else None
        except ValueError:
            at = None
        if at is not None:
            edge = micros(instant(at))
            out = out & F.coalesce(micros(posted) >= edge if above else micros(posted) <= edge, F.lit(False))
    return out


def predicate(f: Filters, now: datetime) -> Column:
    """All filters but the text search, as one column; Catalyst pushes what it can to the scan."""
    c, req = F.col, F.col("requirements")
    owned = F.concat(*(F.coalesce(req[x], F.array().cast("array<string>")) for x in ("requiredSkills", "preferredSkills", "technologies")))
    parts = [
        F.lit(True) if f.include_expired else ~c("isExpired"),
        c("isPathwayRole") if f.only_pathway else F.lit(True),
        ~c("isPathwayRole") if f.include_pathway is False else F.lit(True),
        in_list(c("experienceLevel"), f.experience),
        category_match(c("category"), c("secondaryCategories"), f.categories),
        in_list(c("workArrangement"), f.arrangement),
        in_list(c("employmentType"), f.employment),
        in_list(c("sourceId"), f.sources),
        in_list(city_label(c("city"), c("workArrangement") == "remote"), f.cities),
        in_list(c("company"), f.companies),
        all_of(owned, f.skills),
        any_of(req["certifications"], f.certifications),
        c("salary.min").isNotNull() if f.has_salary else F.lit(True),
        salary_floor(c("salary.annualMin"), c("salary.annualMax"), f.salary_min),
        posted_within(c("postedAt"), f.posted_within_days, now),
        posted_between(c("postedAt"), f.posted_from, f.posted_to),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out
