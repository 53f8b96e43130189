"""Text search over listings: parsing, matching, scores, orders and pages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewell.functions.text import haystack
from tidewell.operators import pages
from tidewell.operators.facets import facet_counts, listing_facets
from tidewell.operators.filters import Filters, predicate
from tidewell.scratch import written

PAGE_SIZES = (1, 100)


@dataclass(frozen=True)
class Query:
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.terms or self.phrases or self.excluded)


def parse_query(q: str | None) -> Query:
    """Quoted phrases, then words; a word with a minus sign before it is excluded."""
    if not q:
        return Query()
    phrases = re.findall(r'"([^"]+)"', q)
    words = re.sub(r'"[^"]+"', " ", q).split()
    minus = lambda w: w.startswith("-") and len(w) > 1
    return Query([w.lower() for w in words if not minus(w)], [p.lower().strip() for p in phrases], [w[1:].lower() for w in words if minus(w)])


def matches(query: Query, hay: Column) -> Column:
    """All terms and phrases are substrings, no excluded word is."""
    out = F.lit(True)
    for x in query.terms + query.phrases:
        out = out & hay.contains(x)
    for x in query.excluded:
        out = out & ~hay.contains(x)
    return out


def text_score(query: Query, title: Column, company: Column | None = None, tags: Column | None = None) -> Column:
    """Points (fixed values): a term 2, and 12 in the title, 6 in the company, 5 in a tag; a phrase 6, and 18 in the title."""
    score, low = F.lit(0), F.lower(title)
    points = lambda test, n: F.when(test, n).otherwise(0)
    for x in query.terms:
        score = score + 2 + points(low.contains(x), 12)
        if company is not None:
            score = score + points(F.lower(company).contains(x), 6)
        if tags is not None:
            score = score + points(F.exists(tags, lambda t: F.lower(t).contains(x)), 5)  # noqa: B023
    for x in query.phrases:
        score = score + 6 + points(low.contains(x), 18)
    return score


def sort_keys(sort: str, score: Column, rank: Column, posted: Column, annual_min: Column, annual_max: Column, company: Column, order: Column) -> list[Column]:
    """The keys of an order, the input order last, as rows that tie keep it."""
    epoch = F.coalesce(F.unix_micros(posted.cast("timestamp")), F.lit(0))
    keys = {
        "newest": [epoch.desc()],
        "oldest": [epoch.asc()],
        "salary": [F.coalesce(annual_max, annual_min, F.lit(-1)).desc()],
        "company": [F.collate(company, "UNICODE").asc(), rank.desc()],
    }.get(sort, [(score * 3 + rank).desc()])
    return [*keys, order.asc()]


def page_bounds(total: int, page: int, size: int) -> tuple[int, int, int, int]:
    """(page, size, pages, offset), each brought into its range."""
    size = min(max(size, PAGE_SIZES[0]), PAGE_SIZES[1])
    pages = max(1, -(-total // size))
    page = min(max(page, 1), pages)
    return page, size, pages, (page - 1) * size


def page_strip(page: int, pages: int, around: int = 2) -> list[int | None]:
    """Page numbers to show: the ends, those near the current one, None for a gap."""
    shown = sorted({1, pages, *range(max(1, page - around), min(pages, page + around) + 1)})
    out: list[int | None] = []
    for a in shown:
        if out and out[-1] is not None and a - out[-1] > 1:
            out.append(None)
        out.append(a)
    return out


@dataclass(frozen=True)
class Result:
    """total and paging are numbers; the page's rows, matched (without the long columns) and facets are lazy."""

    total: int
    page: int
    page_size: int
    pages: int
    rows: DataFrame
    matched: DataFrame
    facets: DataFrame


def listing_haystack() -> Column:
    c, req = F.col, F.col("requirements")
    lists = [F.array_join(req[x], " ") for x in ("technologies", "certifications", "requiredSkills", "preferredSkills")]
    return haystack([c("title"), c("company"), c("city"), c("region"), c("locationRaw"), c("summary"), *lists, c("sourceName"), F.substring(c("description"), 1, 4000)])


#: Offsets beyond which a page is found by counting ranges.
DEEP = 10_000
#: Columns that neither orders nor facets need; a page's rows fetch them by _ord.
WIDE = ["description", "descriptionHtml"]


def search(listings: DataFrame, filters: Filters, now: datetime) -> Result:
    """Filter, match, score, order and cut to a page; facets are over all that match.

    Listings are scanned once: what matches is written with what orders and facets need, and counted as it is written. The page is a top-k
    of that table (a deep one is found by counts), and fetches its long columns by the page's _ord values, which tell listings apart.
    """
    query = parse_query(filters.q)
    matched = listings.where(predicate(filters, now))
    if query:
        matched = matched.where(matches(query, listing_haystack()))
    matched = matched.withColumn("textScore", text_score(query, F.col("title"), F.col("company"), F.col("requirements.technologies")) if query else F.lit(0))
    keys = sort_keys(filters.sort, F.col("textScore"), F.col("rankScore"), F.col("postedAt"), F.col("salary.annualMin"), F.col("salary.annualMax"), F.col("company"), F.col("_ord"))
    seen = Observation()
    narrow = written(matched.drop(*WIDE).observe(seen, F.count(F.lit(1)).alias("n")), "matched")
    total = seen.get["n"]
    page, size, n_pages, offset = page_bounds(total, filters.page, filters.page_size)
    if offset > DEEP and filters.sort != "company":  # a company's order is a collation's
        rows = deep_page(narrow, filters.sort, offset, size)
    else:
        rows = narrow.orderBy(*keys).limit(offset + size).offset(offset)
    wanted = [r["_ord"] for r in rows.select("_ord").collect()]  # a page
    long = listings.where(F.col("_ord").isin(wanted)).select(F.col("_ord").alias("_long"), *(x for x in WIDE if x in listings.columns))
    full = narrow.where(F.col("_ord").isin(wanted)).join(F.broadcast(long), F.col("_ord") == F.col("_long")).orderBy(*keys).select(*listings.columns, "textScore")
    return Result(total, page, size, n_pages, full, narrow, facet_counts(narrow, listing_facets()))


def deep_page(matched: DataFrame, sort: str, offset: int, size: int) -> DataFrame:
    """A page of one of the orders by number or date, with the keys that sort_keys has."""
    epoch = F.coalesce(F.unix_micros(F.col("postedAt").cast("timestamp")), F.lit(0))
    first = {"newest": epoch, "oldest": epoch, "salary": F.coalesce("salary.annualMax", "salary.annualMin", F.lit(-1))}.get(sort, F.col("textScore") * 3 + F.col("rankScore"))
    return pages.page(matched.withColumn("_first", first), [("_first", sort != "oldest"), ("_ord", False)], offset, size).drop("_first")
