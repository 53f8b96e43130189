"""Rule engines as column expressions: vocabularies, ordered rules, scores. Rule packs are data that callers pass in."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


@dataclass(frozen=True)
class Term:
    canonical: str
    aliases: tuple[str, ...] = ()


def term_pattern(term: Term) -> str:
    """Matches any form by itself, whatever separates its words."""
    forms = [re.sub(r"(?:\\ )+", r"[\\s\\-_]+", re.escape(x)) for x in (term.canonical, *term.aliases)]
    return rf"(?i)(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])"


def find_terms(text: Column, vocabulary: list[Term], limit: int = 40) -> Column:
    """Canonical names found, each tested by itself, in the order of the vocabulary."""
    tests = [F.when(text.rlike(term_pattern(t)), F.lit(t.canonical)) for t in vocabulary]
    return F.slice(F.array_compact(F.array(*tests)), 1, limit) if tests else F.array().cast("array<string>")


def first_rule(rules: list[tuple[str, str]], text: Column, default: str | None = None) -> Column:
    """Name of the first rule whose pattern the text has."""
    out = F.lit(default).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def all_rules(rules: list[tuple[str, str]], text: Column, limit: int) -> Column:
    found = F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in rules))) if rules else F.array().cast("array<string>")
    return F.slice(found, 1, limit)


def slice_section(text: Column, start: str, stops: list[str], least: int = 40, most: int = 4000) -> Column:
    """What follows the first start heading, up to the nearest stop heading more than `least` characters on, or `most` characters. Of each stop pattern the first match counts."""

    def ended(rest: Column) -> Column:
        places = F.filter(F.array(*(F.when(rest.rlike(p), F.length(F.regexp_extract(rest, rf"(?s)^(.*?)(?:{p})", 1))) for p in stops)), lambda i: i > least)
        return F.substr(rest, F.lit(1), F.coalesce(F.array_min(places), F.least(F.length(rest), F.lit(most))))

    head = F.regexp_extract(text, rf"(?s)^(.*?(?:{start}))", 1)
    return let(head, lambda h: F.when(h != "", let(F.substr(text, F.length(h) + 1), ended)))


@dataclass(frozen=True)
class RequirementPack:
    skills: list[Term]
    technologies: list[Term]
    certifications: list[Term]
    required: str
    preferred: str
    stop: str
    education: list[tuple[str, str]] = field(default_factory=list)


def extract_requirements(text: Column, pack: RequirementPack) -> Column:
    """A struct of required and preferred skills, technologies, certifications, education and years."""
    stops = [pack.stop, pack.preferred, pack.required]
    none = F.array().cast("array<string>")

    # each step is computed once: terms and sections of the body, then terms of the sections, then what both share
    def read(body: Column) -> Column:
        found = F.struct(
            find_terms(body, pack.skills, 40).alias("skills"), find_terms(body, pack.technologies, 60).alias("technologies"), find_terms(body, pack.certifications, 30).alias("certifications"),
            slice_section(body, pack.required, stops).alias("required"), slice_section(body, pack.preferred, stops).alias("preferred"),
        )
        return let(found, lambda f: let(_terms_of_sections(f, pack), lambda p: let(_shared(p), lambda s: full(body, f, s))))

    def full(body: Column, f: Column, s: Column) -> Column:
        left = F.array_except(F.array_except(s["pool"], s["required"]), s["preferred"])
        divided, lacking = f["required"].isNotNull() | f["preferred"].isNotNull(), F.size(s["required"]) == 0
        required = F.when(~divided, s["pool"]).when(lacking, left).otherwise(s["required"])
        preferred = F.when(~divided, none).when(lacking, s["preferred"]).otherwise(F.slice(F.concat(s["preferred"], left), 1, 30))
        low, label = years_experience(body)
        return F.struct(
            F.slice(required, 1, 30).alias("requiredSkills"), F.slice(preferred, 1, 25).alias("preferredSkills"), F.slice(f["technologies"], 1, 40).alias("technologies"), F.slice(f["certifications"], 1, 20).alias("certifications"),
            all_rules(pack.education, body, 4).alias("education"), label.alias("yearsExperience"), low.alias("yearsExperienceMin"),
        )

    return let(F.substring(text, 1, 30000), read)


def _terms_of_sections(f: Column, pack: RequirementPack) -> Column:
    """pool: all skills and technologies; required, preferred: those of the sections."""
    inside = lambda section: F.when(section.isNotNull(), F.concat(find_terms(section, pack.skills, 40), find_terms(section, pack.technologies, 40))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.array_distinct(F.concat(f["skills"], f["technologies"])).alias("pool"), inside(f["required"]).alias("required"), inside(f["preferred"]).alias("preferred"))


def _shared(p: Column) -> Column:
    """The sections' terms in the pool's order; what is required isn't preferred."""
    required = F.array_intersect(p["pool"], p["required"])
    return F.struct(p["pool"].alias("pool"), required.alias("required"), F.array_except(F.array_intersect(p["pool"], p["preferred"]), required).alias("preferred"))


# ---- fixed values: patterns of levels, employment and years ----
YEARS = r"(?i)(\d{1,2})\s*(?:\+|plus)?\s*(?:-|–|to)?\s*(\d{1,2})?\s*(?:\+)?\s*years?(?:\s+of)?(?:\s+(?:relevant|related|progressive|professional|hands-on|practical|combined|direct))*\s+(?:work\s+)?experience"
LEVELS = [
    ("internship", r"\b(intern(ship)?|summer student|student placement|placement student|stagiaire|apprentice)\b"),
    ("coop", r"\b(co-?op|coop|work term|internship/co-?op|winter 20\d\d|fall 20\d\d|summer 20\d\d)\b"),
    ("executive", r"\b(chief\b|ciso|cio\b|cto\b|c-level|chief information security|chief security|svp|senior vice president|evp|executive vice)\b"),
    ("director", r"\b(director|head of|avp|vice president|vp\b)\b"),
    ("manager", r"\b(manager|mgr\b|supervisor|team lead(er)?\s*,?\s*(soc|security)|people lead)\b"),
    ("lead", r"\b(lead|principal|staff|distinguished|architect|specialist iv|iv\b)\b"),
    ("senior", r"\b(senior|sr\.?|snr|expert|advanced|iii\b|level 3|l3|tier 3|t3)\b"),
    ("junior", r"\b(junior|jr\.?|associate|i{1}\b(?!i)|level 1|l1|tier 1|t1)\b"),
    ("entry", r"\b(entry[- ]?level|graduate|new grad|trainee|early career|no experience|0-2 years)\b"),
    ("mid", r"\b(intermediate|ii\b|level 2|l2|tier 2|t2|mid[- ]?level)\b"),
]
EMPLOYMENT = [
    ("internship", r"(?i)\b(intern(ship)?|co-?op|student|stagiaire|apprentice|work term)\b"),
    ("contract", r"(?i)\b(contract|contractor|fixed[- ]term|freelance|consultant\s+\(|b2b|1099|term position|\d+\s*month(s)?\s+(contract|term))\b"),
    ("temporary", r"(?i)\b(temporary|temp\b|seasonal|casual|relief)\b"),
    ("part_time", r"(?i)\b(part[- ]?time|parttime|pt\b)\b"),
    ("volunteer", r"(?i)\b(volunteer|unpaid)\b"),
    ("full_time", r"(?i)\b(full[- ]?time|fulltime|permanent|regular|ft\b|temps plein)\b"),
]
YEAR_BANDS = [(0, "entry"), (2, "junior"), (5, "mid"), (8, "senior")]


def years_experience(text: Column) -> tuple[Column, Column]:
    """(years, label); years over 30 are null."""
    # each group is read once, and only in texts that have the word at all
    told = text.rlike("(?i)experience")
    label = let(F.struct(F.regexp_extract(text, YEARS, 1).alias("a"), F.regexp_extract(text, YEARS, 2).alias("b")), lambda g: F.when(g["b"] != "", F.concat(g["a"], F.lit("–"), g["b"], F.lit(" years"))).when(g["a"] != "", F.concat(g["a"], F.lit("+ years"))))
    years = let(F.regexp_extract(text, YEARS, 1).try_cast("int"), lambda n: F.when(n <= 30, n))
    return F.when(told, years), F.when(told, label)


def experience_level(title: Column, description: Column) -> Column:
    """By the title's words, else by the description's."""
    d = F.substring(F.lower(description), 1, 6000)
    years, _ = years_experience(d)
    student = d.rlike(r"\bstudent\b")

    def banded(n: Column) -> Column:
        band = F.lit("lead")
        for most, name in reversed(YEAR_BANDS):
            band = F.when(n <= most, name).otherwise(band)
        return F.when(n.isNotNull(), band).when(d.rlike(r"\b(entry[- ]?level|no prior experience|new graduates?)\b"), "entry").otherwise("unknown")

    below = F.when(d.rlike(r"\b(co-?op|work term)\b") & student, "coop").when(d.rlike(r"\bintern(ship)?\b") & student, "internship").otherwise(let(years, banded))
    return F.coalesce(first_rule(LEVELS, F.lower(title)), below)


def employment_type(*texts: Column) -> Column:
    joined = F.concat_ws(" | ", *(F.nullif(t, F.lit("")) for t in texts))
    return first_rule(EMPLOYMENT, joined, "unknown")


@dataclass(frozen=True)
class RelevancePack:
    """Patterns that make a listing relevant; matched without regard to case."""

    core_title: str
    weak_title: str
    pathway_title: str
    body: str
    department: str
    exclude: str
    exclude_unless_core: str
    guard_word: str


@dataclass(frozen=True)
class Category:
    name: str
    title: str
    body: str | None = None
    weight: int = 1


def classify(title: Column, description: Column, department: Column, pack: RelevancePack) -> Column:
    """A struct: score 0 to 100, isPathway, rejectReason. Points (fixed values): core title 62, else weak title 28; 2.2 a body hit, 26 at most; department 8; pathway titles 28 and 2.5 a hit, 18 at most."""
    t, dept = F.coalesce(title, F.lit("")), F.coalesce(department, F.lit(""))
    body = F.substring(F.concat(t, F.lit("\n"), dept, F.lit("\n"), F.coalesce(description, F.lit(""))), 1, 20000)
    has = lambda x, p: x.rlike(f"(?i){p}")
    core, weak, path = has(t, pack.core_title), has(t, pack.weak_title), has(t, pack.pathway_title)
    hits = F.regexp_count(body, F.lit(f"(?i){pack.body}"))
    base = F.when(core, 62.0).when(weak, 28.0).otherwise(0.0) + F.least(F.lit(26.0), hits * 2.2) + F.when(has(dept, pack.department), 8.0).otherwise(0.0)
    pathway = ~core & path
    score = F.when(pathway & (hits >= 1), F.greatest(base, 28.0 + F.least(F.lit(18.0), hits * 2.5))).otherwise(base)
    reason = (
        F.when(has(t, pack.exclude), "excluded by title")
        .when(has(t, pack.guard_word) & ~core & has(F.substring(body, 1, 3000), pack.exclude), "excluded by text")
        .when(has(t, pack.exclude_unless_core) & ~core, "out of field")
        .when(~core & ~path & ~(weak & (hits >= 6)) & (hits < 10), "not relevant")
        .when(pathway & (hits < 1), "pathway without signal")
    )
    return F.struct(F.when(reason.isNull(), F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)) + 0.5).cast("int")).otherwise(0).alias("score"), F.coalesce(F.when(reason.isNull(), pathway), F.lit(False)).alias("isPathway"), reason.alias("rejectReason"))


def categorize(title: Column, body: Column, pathway: Column, categories: list[Category], adjacent: str = "adjacent_it", other: str = "other") -> Column:
    """A struct: category, secondary (at most 3, with a title hit). 10 times the weight for the title, 3 for the body; ties by rule order."""
    scored = [(F.when(title.rlike(f"(?i){c.title}"), 10 * c.weight).otherwise(0) + (F.when(body.rlike(f"(?i){c.body}"), 3).otherwise(0) if c.body else F.lit(0))) for c in categories]
    ranked = F.array_sort(F.filter(F.array(*(F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(c.name).alias("c")) for i, (s, c) in enumerate(zip(scored, categories, strict=True)))), lambda x: x["s"] < 0))
    top = F.get(ranked, F.lit(0))
    primary = F.when(F.size(ranked) == 0, F.when(pathway, adjacent).otherwise(other)).when(pathway & (top["s"] > -10), adjacent).otherwise(top["c"])
    rest = F.transform(F.filter(F.slice(ranked, 2, len(categories)), lambda x: (x["s"] <= -5) & (x["c"] != primary)), lambda x: x["c"])
    return F.struct(primary.alias("category"), F.slice(rest, 1, 3).alias("secondary"))


def rank_score(relevance: Column, age_days: Column, has_salary: Column, length: Column, home: Column, remote: Column, expired: Column, pathway: Column) -> Column:
    """Relevance, freshness, pay, depth and region in one number, 0 to 150 (fixed values); a null age counts as 45 days."""
    age = F.coalesce(age_days, F.lit(45.0))
    fresh = F.when(age <= 1, 18).when(age <= 3, 14).when(age <= 7, 10).when(age <= 14, 5).when(age <= 30, 1).when(age > 60, -12).otherwise(-5)
    yes = lambda c, n: F.when(c, n).otherwise(0)
    s = relevance + fresh + yes(has_salary, 6) + F.when(length > 1200, 4).when(length < 300, -8).otherwise(0) + F.when(home, 8).when(remote, 4).otherwise(0) + yes(pathway, -10) + yes(expired, -40)
    return F.floor(F.least(F.greatest(s, F.lit(0)), F.lit(150)) + 0.5).cast("int")
