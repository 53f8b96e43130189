"""Pay: reading amounts, periods and currencies from text, and showing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squeezed, stripped

# ---- fixed values ----
#: Words for pay periods, tested in this order.
PERIODS = [
    ("hour", r"\b(per|/|an )?\s*hour|hourly|/hr|/h\b|per hour|de l'heure|horaire"), ("day", r"\bper\s*day|/day|daily|per diem\b"), ("week", r"\bper\s*week|/week|weekly|hebdomadaire\b"), ("biweekly", r"\bbi-?weekly|every two weeks\b"),
    ("month", r"\bper\s*month|/month|monthly|mensuel|par mois\b"), ("year", r"\bper\s*(year|annum)|/year|/yr|annually|annual|yearly|par an|annuel\b"),
]
#: Signs of currencies, tested in this order.
CURRENCIES = [("CAD", r"\bCAD\b|\bC\$"), ("USD", r"\bUSD\b|\bUS\$"), ("EUR", r"\bEUR\b|€"), ("GBP", r"\bGBP\b|£"), ("CAD", r"\$")]
#: Periods in a year.
A_YEAR = {"hour": 2080, "day": 260, "week": 52, "biweekly": 26, "month": 12, "year": 1}
UNITS = {"hour": "/hr", "day": "/day", "week": "/wk", "biweekly": "/2wks", "month": "/mo"}
#: An amount, as it is searched for.
AMOUNT = r"\$?\s?\d{1,3}(?:[,\s\u00A0']\d{3})*(?:\.\d{1,2})?[kK]?|\$?\s?\d+(?:\.\d{1,2})?[kK]?"
RANGE = rf"(?iu)({AMOUNT})\s*(?:-|–|—|to|à|and)\s*({AMOUNT})"
SINGLE = rf"(?i)(?:\$|CAD|USD)\s?({AMOUNT})"
#: Pay in running text, in order of trust.
IN_TEXT = [
    r"(?iu)(?:salary|compensation|pay|base pay|pay range|salary range|compensation range|hiring range|rémunération|salaire)[^\n]{0,60}?(\$[\d,. ]+\s*(?:-|–|to)\s*\$?[\d,. ]+[^\n]{0,40})",
    r"(?i)(\$\s?\d{2,3}(?:[,\s]\d{3})+\s*(?:-|–|to)\s*\$?\s?\d{2,3}(?:[,\s]\d{3})+(?:\s*(?:per|/)\s*(?:year|annum|hour|hr))?)",
    r"(?i)(\$\s?\d{1,3}(?:\.\d{2})?\s*(?:-|–|to)\s*\$?\s?\d{1,3}(?:\.\d{2})?\s*(?:per hour|/\s*hour|/hr|hourly))",
]
TYPE = "struct<min:double,max:double,currency:string,period:string,annualMin:bigint,annualMax:bigint,raw:string>"


def _first(x: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(x.rlike(pattern), name).otherwise(out)
    return out


def detect_period(x: Column) -> Column:
    return _first(F.lower(x), PERIODS)


def detect_currency(x: Column) -> Column:
    return _first(F.upper(x), CURRENCIES)


def to_number(x: Column) -> Column:
    number = lambda bare: F.regexp_extract(F.regexp_replace(bare, "[kK]$", ""), r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double") * F.when(bare.rlike("[kK]$"), 1000.0).otherwise(1.0)
    return let(F.regexp_replace(x, "[^0-9.kK]", ""), number)


def parse_salary(raw: Column, context: Column | None = None) -> Column:
    """A struct of amounts, currency, period and yearly amounts; its fields are null where the text says nothing sure. Context: text beside it, of which 400 characters say the period."""
    first = stripped(F.coalesce(raw, F.lit("")))
    beside = F.substring(F.coalesce(context, F.lit("")), 1, 400) if context is not None else F.lit("")
    # each step names its results once, so the expression doesn't grow with every use of them
    texts = F.struct(first.alias("text"), F.concat_ws(" ", first, beside).alias("around"))
    return let(texts, lambda t: let(_amounts(t["text"]), lambda a: _pay(t["text"], t["around"], a)))


def _amounts(text: Column) -> Column:
    # an amount has a digit, so an empty group means that nothing was found; without a digit there is no amount at all
    digits = text.rlike("(?u)\\d")
    both = F.struct(F.when(digits, F.regexp_extract(text, RANGE, 1)).otherwise("").alias("a"), F.when(digits, F.regexp_extract(text, RANGE, 2)).otherwise("").alias("b"))
    single = F.when(digits, F.regexp_extract(text, SINGLE, 1)).otherwise("")
    found = let(both, lambda g: F.when(g["a"] != "", g).otherwise(F.struct(single.alias("a"), F.lit("").alias("b"))))
    number = lambda x: F.when(x != "", to_number(x))
    pair = let(found, lambda g: F.struct(number(g["a"]).alias("a"), number(g["b"]).alias("b")))

    def ordered(p: Column) -> Column:
        both = p["a"].isNotNull() & p["b"].isNotNull()
        return F.struct(F.when(both, F.least(p["a"], p["b"])).otherwise(p["a"]).alias("low"), F.when(both, F.greatest(p["a"], p["b"])).otherwise(p["b"]).alias("high"))

    return let(pair, ordered)


def _pay(text: Column, around: Column, amounts: Column) -> Column:
    low, high = amounts["low"], amounts["high"]
    probe = F.coalesce(high, low)
    guess = F.when((probe > 0) & (probe < 200), "hour").when((probe >= 200) & (probe < 3000), "week").when((probe >= 3000) & (probe < 25000), "month").otherwise("year")
    times = F.create_map(*(F.lit(v) for k, n in A_YEAR.items() for v in (k, float(n))))
    none = F.lit(None)
    empty = F.struct(none.cast("double").alias("min"), none.cast("double").alias("max"), none.cast("string").alias("currency"), none.cast("string").alias("period"), none.cast("bigint").alias("annualMin"), none.cast("bigint").alias("annualMax"), F.nullif(text, F.lit("")).alias("raw"))

    def full(period: Column) -> Column:
        year = lambda v: F.floor(v * F.element_at(times, period) + 0.5).cast("bigint")
        return F.struct(low.alias("min"), high.alias("max"), F.coalesce(detect_currency(around), F.lit("CAD")).alias("currency"), period.alias("period"), year(low).alias("annualMin"), year(high).alias("annualMax"), text.alias("raw")).cast(TYPE)

    return F.when((text == "") | probe.isNull() | (probe <= 0) | (probe > 10_000_000), empty.cast(TYPE)).otherwise(let(F.coalesce(detect_period(around), guess), full))


def find_salary(x: Column) -> Column:
    window = F.substring(x, 1, 12000)
    own = lambda p: let(F.regexp_extract(window, p, 1), lambda found: F.nullif(found, F.lit("")))
    # every pattern has an amount in dollars
    return squeezed(F.when(window.contains("$"), F.coalesce(*map(own, IN_TEXT))))


def format_salary(s: Column) -> Column:
    sign = F.when(s["currency"] == "USD", "US$").otherwise("$")
    plain = lambda n: F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    say = lambda n: F.concat(sign, F.when(s["period"] == "hour", F.format_string("%.2f", n)).when(n >= 1000, F.format_number(F.floor(n + 0.5), 0)).otherwise(plain(n)))
    unit = F.lit("/yr")
    for k, v in UNITS.items():
        unit = F.when(s["period"] == k, v).otherwise(unit)
    two = s["min"].isNotNull() & s["max"].isNotNull() & (s["min"] != s["max"])
    return F.when(two, F.concat(say(s["min"]), F.lit(" – "), say(s["max"]), unit)).otherwise(F.concat(say(F.coalesce(s["min"], s["max"])), unit))
