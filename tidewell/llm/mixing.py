"""Operator 3, mixing sources to target weights: Poisson replication.

A source's mean repetition rate is its target weight times the total size over its own size. A document's count is the inverse of the
Poisson distribution with that mean at a uniform number hashed from the seed and the document's id and text, so it doesn't depend on
partitions or on other documents. Each document is exploded by its count, and the copies are put in the order of a hash: dealt to
partitions by it and sorted by it there.

Target weights: given by name as fractions of the output, or else proportional to size ** alpha (alpha 1 keeps the proportions, 0 makes
sources equal). Sources that are given no weight keep rate 1, and the weights are scaled to what those leave.
Size: documents. Means over PIECE are the sum of several independent counts, so exp(-mean) doesn't underflow.

Defined cases: a null source is a source of its own; null and empty texts are replicated as any other; equal rows get equal counts; a null
doc_id hashes as the empty string; extra columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, staged

SEED = 17
ALPHA = 0.5
PIECE = 64.0
#: Terms of a piece's distribution: beyond them lies less than 1e-12 of a Poisson distribution with mean PIECE.
TERMS = 160
#: Pieces or copies of a document in one array.
CHUNK = 4096


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 48 random bits, from an md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """source, rate, pieces, cdf: mean repetitions of a source's documents and its distribution's cumulative probabilities."""
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        share = F.pow("n", F.lit(float(alpha)))
        total = sizes.agg(F.sum(share).alias("shares"), F.sum("n").alias("every"))
        rate = share / F.col("shares") * F.col("every") / F.col("n")
        out = sizes.join(F.broadcast(total), F.lit(True)).withColumn("rate", rate)  # one row
    else:
        whole = sum(weights.values())
        given = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v) / whole))) if weights else F.lit(None)
        share = F.try_element_at(given, F.coalesce("source", F.lit("\0"))) if weights else F.lit(None).cast("double")
        total = sizes.agg(F.sum(F.when(share.isNotNull(), F.col("n"))).alias("every"))
        out = sizes.join(F.broadcast(total), F.lit(True)).withColumn("rate", F.coalesce(share * F.col("every") / F.col("n"), F.lit(1.0)))  # one row
    mean = F.col("rate") / F.col("pieces")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))
    step = lambda s, k: F.struct((s["p"] * F.col("mean") / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * F.col("mean") / k)).alias("cdf"))
    out = out.withColumn("pieces", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")).withColumn("mean", mean)
    return out.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["cdf"]).select("source", "rate", "pieces", "cdf")


def _count(pieces: Column, name: Column, cdf: Column) -> Column:
    """Sum of the independent counts of some pieces (numbers from 1), each the inverse of the distribution at a hashed uniform number."""
    draws = F.transform(pieces, lambda i: uniform(name, i.cast("string")))
    return F.aggregate(draws, F.lit(0), lambda t, u: t + F.size(F.filter(cdf, lambda c: c <= u)))


def _part(n: Column, k: Column, chunk: int) -> Column:
    """The numbers of chunk k (from 0) of 1 to n."""
    return F.sequence(k * chunk + 1, F.least((k + 1) * chunk, n).cast("int"))


def _chunks(n: Column, chunk: int) -> Column:
    return F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """docs' columns and a struct `mix` (n_copies, copy, rate, shuffle_key) of each copy, in the order of shuffle_key within partitions dealt by it.

    No array holds more than `chunk` pieces or copies of a document. Documents of sources with more pieces than that are spread over tasks by
    chunks, both to count and to copy them.
    """
    mix, source, rate, pieces, cdf, base, part, n, copy, row = (fresh(x, docs.columns) for x in ("mix", "mix_source", "mix_rate", "mix_pieces", "mix_cdf", "mix_base", "mix_part", "mix_n", "mix_copy", "mix_row"))
    table = staged(rates(docs, weights, alpha), "rates").select(F.col("source").alias(source), F.col("rate").alias(rate), F.col("pieces").alias(pieces), F.col("cdf").alias(cdf))
    small = table.count() <= BROADCAST_ROWS
    of_row = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))

    def joined(rows: DataFrame) -> DataFrame:  # every source has a row
        return docs.join(F.broadcast(rows) if small else rows, F.col("source").cast("string").eqNullSafe(F.col(source))).withColumn(base, of_row).drop(source)

    def copied(counted: DataFrame, spread: bool) -> DataFrame:  # exploded by chunks, then within them; spread: a document's chunks are dealt to all tasks
        chunks = counted.select(*docs.columns, rate, base, n).where(F.col(n) > 0).withColumn(part, F.explode(_chunks(F.col(n), chunk)))
        return (chunks.repartition(base, part) if spread else chunks).withColumn(copy, F.explode(_part(F.col(n), F.col(part), chunk))).drop(part)

    copies = copied(joined(table.where(F.col(pieces) <= chunk)).withColumn(n, _count(F.sequence(F.lit(1), F.col(pieces)), F.col(base), F.col(cdf))), False)
    if (table.agg(F.max(pieces)).first()[0] or 0) > chunk:  # few documents, or they couldn't be repeated so often
        heavy = staged(joined(table.where(F.col(pieces) > chunk)).withColumn(row, F.monotonically_increasing_id()), "heavy")
        parts = heavy.select(row, base, cdf, pieces, F.explode(_chunks(F.col(pieces), chunk)).alias(part)).repartition(row, part)
        sums = parts.groupBy(row).agg(F.sum(_count(_part(F.col(pieces), F.col(part), chunk), F.col(base), F.col(cdf))).cast("int").alias(n))
        copies = copies.unionByName(copied(heavy.join(sums, row), True))
    key = F.md5(F.concat_ws("|", F.col(base), F.lit("order"), F.col(copy).cast("string")))
    made = copies.select(*docs.columns, F.struct(F.col(n).alias("n_copies"), F.col(copy).alias("copy"), F.col(rate).alias("rate"), key.alias("shuffle_key")).alias(mix))
    return made.repartition(F.col(mix)["shuffle_key"]).sortWithinPartitions(F.col(mix)["shuffle_key"])


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """docs' columns, a row for each copy, globally shuffled."""
    return replicated(docs, weights, alpha, seed).select(*docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = F.col("mix")
    return replicated(docs).select(*docs.columns, m["n_copies"].alias("n_copies"), m["copy"].alias("copy"), F.round(m["rate"], 9).alias("rate"), m["shuffle_key"].alias("shuffle_key"))


OP3_SQL = f"""
WITH sizes AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source),
total AS (SELECT sum(pow(n, {ALPHA})) AS shares, sum(n) AS every FROM sizes),
rates AS (SELECT source, pow(n, {ALPHA}) / shares * every / n AS rate, CAST(greatest(ceil(pow(n, {ALPHA}) / shares * every / n / {PIECE}), 1) AS INT) AS pieces FROM sizes, total),
terms AS (SELECT source, rate, pieces, k, exp(-(rate / pieces) + k * ln(rate / pieces) - lgamma(k + 1)) AS p FROM rates, range(0, {TERMS + 1}) t(k)),
cdf AS (SELECT source, rate, pieces, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
base AS (SELECT *, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS base, row_number() OVER () AS rid FROM documents),
draws AS (SELECT rid, base, source, i, CAST(CAST(('0x' || substr(md5(base || '|' || i), 1, 12)) AS BIGINT) AS DOUBLE) / {float(1 << 48)} AS u FROM base JOIN rates r USING (source), range(1, r.pieces + 1) p(i)),
counts AS (SELECT rid, count(c.k) AS n_copies FROM draws d LEFT JOIN cdf c ON c.source = d.source AND c.c <= d.u GROUP BY rid)
SELECT b.doc_id, b.text, b.lang, b.source, b.n_chars, CAST(n_copies AS INT) AS n_copies, CAST(copy AS INT) AS copy, round(rate, 9) AS rate, md5(base || '|order|' || copy) AS shuffle_key
FROM base b JOIN counts USING (rid) JOIN rates r ON r.source = b.source, range(1, n_copies + 1) t(copy)
"""
