"""Operator 6, benchmark decontamination: a prefix-filtered set join of benchmark windows with all places of the documents.

A window is WINDOW consecutive words of an item (an item of fewer words is one window). As a window must be contained whole, its necessary
prefix is one token: its rarest word by the counts of the whole corpus. Windows that share that word at the same place of an item share
one prefix row. The document's words are joined with the prefix rows; a match aligns item and document, the length and positional bounds
say which windows can lie there, and their words are compared one by one. Nothing but DataFrame functions runs.

The prefix rows are broadcast in blocks of at most BLOCK rows, each block a pass over the documents, so a benchmark of any size fits.

Defined cases: null and wordless documents have no words and no hits; null and wordless items have no windows; items that share a window are
all counted; rows with equal doc_ids are rows of their own; a null item_id is named by the empty string; extra columns are ignored; an empty documents table
gives an empty result, and with an empty benchmark no document has hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD_BREAK, fresh, staged

WINDOW = 10
BLOCK = 20_000


def word_array(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), WORD_BREAK), "")


def prefixes(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """word, item_id, q (its place in the item), starts (of the windows it stands for), size, around (the item's words from place `low` on)."""
    items = staged(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), word_array(F.col("text")).alias("words")).where(F.size("words") > 0).select("item_id", "words", F.xxhash64("item_id", "words").alias("item")), "items")
    vocabulary = items.select(F.explode("words").alias("word")).distinct()
    counts = _per_block(vocabulary, lambda part: docs.select(F.explode(word_array(F.col("text"))).alias("word")).join(part, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    seen = items.select("item", F.posexplode("words").alias("at", "word")).join(staged(counts, "counts"), "word", "left")
    rarity = seen.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("n"))
    size = F.least(F.size("words"), F.lit(window))
    windows = items.dropDuplicates(["item"]).join(rarity, "item").select("item_id", "words", "n", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("start"))
    rarest = F.array_min(F.transform(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1), lambda k: F.struct(F.get("n", k).alias("n"), k.alias("at"))))["at"]
    placed = windows.withColumn("q", rarest).withColumn("low", F.greatest(F.col("q") - window + 1, F.lit(0)))
    row = placed.select("item_id", "q", "size", "low", F.get("words", F.col("q")).alias("word"), F.slice("words", F.col("low") + 1, F.lit(2 * window)).alias("around"), "start")
    return row.groupBy("word", "item_id", "q", "size", "low", "around").agg(F.collect_set("start").alias("starts"))


def _per_block(table: DataFrame, use) -> DataFrame:
    """use(block) for each broadcast block of the table, united."""
    held = staged(table, "block-table")
    n = max(1, -(-held.count() // BLOCK))
    out = None
    for i in range(n):
        part = use(F.broadcast(held if n == 1 else held.where(F.pmod(F.xxhash64("word"), F.lit(n)) == i)))  # about BLOCK rows; a word's rows stay together
        out = part if out is None else out.unionByName(part)
    return out


def scanned(docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = WINDOW) -> DataFrame:
    """row, the carried columns' hits: n_words, n_hit, n_items, items (sorted ids) for every row of docs. docs: a column `row` that tells rows apart, `text`, and carry."""
    table = prefixes(docs, benchmark, window)
    empty = "word string, item_id string, q int, size int, low int, around array<string>, starts array<int>"
    end = docs.sparkSession.createDataFrame([("", None, None, None, None, None, None)], empty)  # one row of each document matches it

    def use(part):
        text = docs.select(*carry, word_array(F.col("text")).alias("words"))
        placed = text.select(*carry, "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("p", "word"))
        first = F.greatest(F.col("p") - window + 1, F.lit(0))
        # only the words near a match leave the join: rows with whole texts would grow with the square of a text's length
        near = placed.join(part, "word").select(*carry, F.size("words").cast("long").alias("n_words"), "item_id", "q", "size", "low", "around", "starts", "p", first.alias("first"), F.slice("words", first + 1, F.lit(2 * window)).alias("near"))
        at = lambda s: F.col("p") - F.col("q") + s
        # a second use of `near` keeps the optimiser from moving its making, and the whole texts with it, up into the lambda
        fits = lambda s: (at(s) >= 0) & (at(s) + F.col("size") <= F.col("n_words")) & (F.size("near") > 0)
        equal = lambda s: F.when(fits(s), F.slice("near", at(s) - F.col("first") + 1, F.col("size")) == F.slice("around", s - F.col("low") + 1, F.col("size"))).otherwise(False)
        hits = F.transform(F.filter("starts", equal), lambda s: F.struct(at(s).alias("a"), (at(s) + F.col("size")).alias("b")))
        # unverified matches stay, with no hits: a filter on hits would move into the join and stop its code generation
        return near.select(*carry, "n_words", "item_id", hits.alias("hits"))

    held = staged(table, "prefixes")
    found = _per_block(held.unionByName(end), use)
    group = found.groupBy(*carry).agg(F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("hits"))).alias("spans"), F.array_sort(F.collect_set(F.when(F.size("hits") > 0, F.col("item_id")))).alias("items"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], x["b"]).alias("upto"))
    return group.select(*carry, "n_words", F.aggregate("spans", start, step)["n"].cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items of every row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return scanned(rows, benchmark, ["row", "doc_id"], window).drop("row")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that no window occurs in, with their own columns; equal texts share their fate."""
    key, hit = fresh("text_key", docs.columns), fresh("hit_key", docs.columns)
    of_text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(1))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), of_text.alias("text_key"), "text")
    bad = staged(scanned(rows, benchmark, ["row", "text_key"], window).where("n_hit > 0").select(F.col("text_key").alias(hit)).distinct(), "hits")
    if bad.count() <= 300_000:
        bad = F.broadcast(bad)
    return docs.withColumn(key, of_text).join(bad, F.col(key) == F.col(hit), "left_anti").select(*docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, w[s + 1 : s + least(len(w), {WINDOW})] AS win FROM (SELECT item_id, w, unnest(range(0, len(w) - least(len(w), {WINDOW}) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT rid, size, s, w[s + 1 : s + size] AS win FROM (SELECT rid, size, w, unnest(range(0, greatest(len(w) - size + 1, 0))) AS s FROM d, sizes)),
hits AS (SELECT rid, item_id, s, dw.size AS size FROM dw JOIN iw ON iw.win = dw.win AND iw.size = dw.size),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + size)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)
"""
