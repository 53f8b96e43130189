"""Operator 13, filter interaction audit: direct relational replay of five filters in all 120 orders.

Every document's flags are crossed with the 120 orders (a broadcast table of that fixed size). In each order the first failing step removes
the document; five steps are exploded, and every (part, order, step) sums its conditions. The sums are combined within each task before
they are shuffled, so that 600 rows a part and task leave it, however many documents a part has.

A document fails, with words as maximal runs of other than white space: A under 200 words; B under half of its words distinct; C over 3 % of
its code points in A-Z; D any of #$%&*|; E a text that a smaller doc_id has anywhere in the table.

Defined cases: a null text is an empty one, so null and empty texts are equal; no text, no words: it fails A, not B and C. A null doc_id is
neither smaller nor larger than another and has no labels; rows that share a doc_id don't fail E by each other. A doc_id labelled more than
once is good (toxic) if any of its labels says so. A null lang is the part '', together with an empty lang. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

FILTERS = "ABCDE"
BLANK = r"[\x20\x09-\x0D]+"
#: Documents that a task of the replay takes; each gives 600 rows to the task's own hash table.
TASK_ROWS = 250_000
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, key (of the text), fails (bits of A to D)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.md5(text.cast("binary"))).alias("key"),
        F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("n_distinct")).alias("w"),
        (100 * F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.char_length(text).cast("long")).alias("c"),
        text.rlike(r"[#$%&*|]").alias("d"),
    )
    flags = [F.col("w.n") < 200, 100 * F.col("w.n_distinct").cast("long") < 50 * F.col("w.n").cast("long"), F.col("c"), F.col("d")]
    bits = [F.when(x, 1 << i).otherwise(0) for i, x in enumerate(flags)]
    return rows.select("doc_id", "part", "key", (bits[0] + bits[1] + bits[2] + bits[3]).alias("fails"))


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of A to E), good, toxic of every document."""
    rows = staged(text_flags(docs), "audit-flags")
    # a text's least id is found by partial aggregates; a text of very many copies is then hot on one side of a join, which adaptive execution
    # splits, as both sides are tables
    least = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "least")
    least = staged(least, "audit-least")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    joined = rows.join(least, "key", "left").select("doc_id", "part", (F.col("fails") + F.when(later, 16).otherwise(0)).alias("fails")).join(marks, "doc_id", "left")
    mark = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return staged(joined.select("part", "fails", mark("good"), mark("toxic")), "audit-documents")


def orders(spark: SparkSession) -> DataFrame:
    """The 120 orders: place, filter_order, masks (the bit of each step's filter)."""
    rows = [(k, "".join(p), [1 << FILTERS.index(x) for x in p]) for k, p in enumerate(permutations(FILTERS))]
    return spark.createDataFrame(rows, "place int, filter_order string, masks array<int>")


def replayed(flags: DataFrame) -> DataFrame:
    """One row for each part, order and step. flags: part, fails, good, toxic."""
    spark = flags.sparkSession
    table = orders(spark)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-flags.count() // TASK_ROWS))
    crossed = flags.repartition(tasks).crossJoin(F.broadcast(table.select("place", "masks")))
    first = F.lit(6)
    for step in range(5, 0, -1):
        first = F.when(F.col("fails").bitwiseAND(F.col("masks")[step - 1]) != 0, step).otherwise(first)
    steps = crossed.withColumn("first", first).select("part", "place", "fails", "good", "toxic", "first", F.posexplode("masks").alias("at", "mask"))
    step = F.col("at") + 1
    fails_here, removed = F.col("fails").bitwiseAND(F.col("mask")) != 0, F.col("first") == step
    conditions = {
        "kept": F.col("first") > step,
        "removed": removed,
        "redundant": fails_here & (F.col("first") < step),
        "unique_fails": F.col("fails") == F.col("mask"),
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("toxic"),
    }
    sums = steps.groupBy("part", "place", "at").agg(*(F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(k) for k, c in conditions.items()))
    named = sums.join(F.broadcast(table), "place").withColumn("step", (F.col("at") + 1).cast("int"))
    # 600 rows a part; a filter's 120 rows in a part are one for each order
    share = F.sum("removed").over(Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1))))
    return named.withColumn("shapley", share).select("part", "filter_order", "step", *COUNTS, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return replayed(document_flags(docs, labels))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    len(w) < 200 AS a,
    100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY t), false) AS e
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5
), failing AS (
  SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END,
                                   CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS f
  FROM flags
), replay AS (
  SELECT part, good, toxic, f, filter_order,
    coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda i: contains(f, substr(filter_order, i, 1)))), 6) AS first
  FROM failing, orders
), steps AS (
  SELECT part, filter_order, step,
    CAST(sum(CASE WHEN first > step THEN 1 ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN first = step THEN 1 ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN first < step AND contains(f, substr(filter_order, step, 1)) THEN 1 ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN f = substr(filter_order, step, 1) THEN 1 ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN first = step AND good = 1 THEN 1 ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN first = step AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM replay, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step)
  GROUP BY part, filter_order, step
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM steps
"""
