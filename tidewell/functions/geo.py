"""Locations: a gazetteer join, and flags of provinces, countries and remote work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ACCENTS

# ---- fixed values ----
REMOTE = r"(?i)\b(remote|work\s*from\s*home|wfh|telecommute|distributed|anywhere|virtual)\b"
HYBRID = r"(?i)\b(hybrid|flex(ible)?\s*(work|hybrid)|[0-9]\s*days?\s*(in|per week in)\s*(the\s*)?office|partially remote)\b"
HOME_WORDS = r"\b(ontario|on|ont)\b"
COUNTRY_WORDS = ["canada", "canadian", "ontario", "quebec", "british columbia", "alberta", "manitoba", "saskatchewan", "nova scotia", "new brunswick", "newfoundland", "prince edward island", "yukon", "nunavut", "northwest territories"]
PROVINCES = r"\b(on|qc|bc|ab|mb|sk|ns|nb|nl|pe|yt|nt|nu)\b"
ABROAD = r"\b(united states|usa|u s a|us)\b"
#: Needles at least this long are also found inside words.
INSIDE = 5


@dataclass(frozen=True)
class Place:
    name: str
    region: str
    aliases: tuple[str, ...] = ()


def place_key(x: Column) -> Column:
    plain = F.regexp_replace(F.translate(F.lower(F.coalesce(x, F.lit(""))), *ACCENTS), r"[̀-ͯ]", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def is_remote(x: Column) -> Column:
    return F.coalesce(x.rlike(REMOTE), F.lit(False))


def is_hybrid(x: Column) -> Column:
    return F.coalesce(x.rlike(HYBRID), F.lit(False))


def needles(places: DataFrame) -> DataFrame:
    """needle, n_words, length, place, region, ord from name, region, aliases, ord: a row for each name and alias."""
    all_names = places.select("name", "region", "ord", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("nth", "form"))
    keyed = all_names.select(place_key(F.col("form")).alias("needle"), F.col("name").alias("place"), "region", F.struct("ord", "nth").alias("ord")).where("needle <> ''")
    return keyed.withColumn("n_words", F.size(F.split("needle", " "))).withColumn("length", F.length("needle"))


def match_places(texts: DataFrame, column: str, places: DataFrame) -> DataFrame:
    """_text, place, region for each distinct text of the column: the longest needle that stands as words, else the longest of INSIDE letters and more anywhere.

    Word matches are an equi-join of the text's word n-grams with the needles. Texts without one join with the needles by INSIDE letters
    that both have (a needle's first ones), and what meets is compared, so a gazetteer of any size is neither broadcast nor compared whole.
    """
    dim = needles(places).select("needle", "n_words", "length", F.struct(F.col("place").alias("place"), F.col("region").alias("region")).alias("_spot"), F.struct((-F.col("length")).alias("l"), "ord").alias("_by"))
    longest = dim.agg(F.max("n_words")).first()[0] or 1
    keys = texts.select(F.col(column).alias("_text")).where(F.col("_text").isNotNull()).distinct().withColumn("k", place_key(F.col("_text")))
    words = F.split("k", " ")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " "))))
    best = F.min_by("_spot", "_by").alias("hit")
    whole = keys.select("_text", F.explode(F.array_distinct(grams)).alias("needle")).join(dim, "needle").groupBy("_text").agg(best)
    left = keys.join(whole, "_text", "left_anti")
    heads = F.transform(F.sequence(F.lit(1), F.length("k") - INSIDE + 1), lambda i: F.substring("k", i, INSIDE))
    cut = left.where(F.length("k") >= INSIDE).select("_text", "k", F.explode(F.array_distinct(heads)).alias("head"))
    long = dim.where(F.col("length") >= INSIDE).withColumn("head", F.substring("needle", 1, INSIDE))
    inside = cut.join(long, "head").where(F.col("k").contains(F.col("needle"))).groupBy("_text").agg(best)
    return whole.unionByName(inside).select("_text", F.col("hit.place").alias("place"), F.col("hit.region").alias("region"))


def locate(rows: DataFrame, column: str, places: DataFrame) -> DataFrame:
    """Adds geo: city, region, country, isOntario, isCanada, isRemote."""
    found = match_places(rows, column, places)
    k = F.concat(F.lit(" "), place_key(F.col(column)), F.lit(" "))
    home = F.col("_hit.place").isNotNull() | k.rlike(HOME_WORDS)
    here = home | k.rlike("|".join(COUNTRY_WORDS)) | k.rlike(PROVINCES)
    country = F.when(here, "Canada").when(k.rlike(ABROAD), "United States")
    geo = F.struct(F.col("_hit.place").alias("city"), F.col("_hit.region").alias("region"), country.alias("country"), home.alias("isOntario"), here.alias("isCanada"), is_remote(F.col(column)).alias("isRemote"))
    hit = found.select("_text", F.struct("place", "region").alias("_hit"))
    joined = rows.join(hit, F.col(column) == F.col("_text"), "left")
    return joined.withColumn("geo", geo).select(*rows.columns, "geo")


def region_of(city: Column, places: list[Place]) -> Column:
    names: dict[str, str] = {}
    for p in places:
        names.setdefault(p.name, p.region)
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), city) if names else F.lit(None).cast("string")
