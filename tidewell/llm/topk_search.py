"""Operator 11, exact top-k search: columnar branch-and-bound over vectors in vertical layout.

Components become integers, floor(256 * x). A task holds a block of candidates by dimension (a row of numbers for each dimension) and adds
up inner products one block of dimensions after another. After each, the lengths of what remains of a query and of a candidate bound the rest
of their product (Cauchy and Schwarz); pairs whose bound is below the query's k-th best score so far are given up, and the survivors are
compacted: first whole rows and columns of the tile, then, once few are left, single pairs, whose remaining dimensions are gathered column
by column. Dimensions go in the order of their share of all lengths, so that what remains is small early.

Queries are taken in blocks of about QUERY_ROWS, each broadcast to one pass over all vectors: the work is queries times rows, as asked, and
what is broadcast doesn't grow. Before its pass a block meets SEEDS vectors, whose k-th best scores are the first bounds; they save work and
keep what tasks emit small, but decide nothing. A task emits k rows a query at most, and a ranking window with a limit of its own joins them.

All sums are exact: single or double precision is used only where the product of the largest lengths shows that every partial sum fits.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither as queries nor as candidates. Rows are told
apart as rows, so another row with the query's vec_id is a candidate. Equal scores go to the smaller vec_id, a null one last, and between
rows of one vec_id arbitrarily. Vectors of different lengths are compared as if zeros followed the shorter one; an empty vector scores 0.
Whole-number lengths beyond 2^24 (a component of some 65,000) are an error, as their scores couldn't be held exactly. Extra columns are
ignored; an empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, staged

SCALE, K, QUERY_STEP = 256, 5, 50
#: Queries that a pass over the vectors takes (on average: they are dealt by hash).
QUERY_ROWS = 16_384
#: Vectors that give the first bounds.
SEEDS = 4096
#: Candidates and queries of a tile, and dimensions that are added before bounds are looked at.
BLOCK, TILE, STEP = 4096, 256, 16
#: Share of surviving pairs under which they are held one by one.
SPARSE = 1 / 16
#: Largest whole-number length of a vector.
LONGEST = 2**24
FOUND = "q long, score long, vec_id long, row long"


def coded(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """row, vec_id, v (whole numbers), n2 (squared length) of the vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    sound = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.when(sound, v), lambda x: F.floor(SCALE * x).cast("double")).alias("v"))
    n2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return staged(rows.where("v is not null").select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", n2.alias("n2")), "search-vectors")


# ---- numpy side ----


class Vectors:
    """Rows of an Arrow table: row, vec_id (null ones flagged), and the numbers as a matrix of row x dimension."""

    def __init__(self, table: pa.Table | pa.RecordBatch, order: np.ndarray, kind: type):
        ids = table.column("vec_id")
        self.null = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.row = np.asarray(table.column("row")).astype(np.int64)
        lists = table.column("v")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.asarray(lists.value_lengths()).astype(np.int64)
        flat = np.asarray(lists.flatten())
        v = np.zeros((len(sizes), len(order)))
        v[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        self.v = v[:, order].astype(kind)
        self.rest = rest(v[:, order])

    def taken(self, keep: np.ndarray) -> Vectors:
        new = object.__new__(Vectors)
        for name in ("null", "ids", "row", "v", "rest"):
            setattr(new, name, getattr(self, name)[keep])
        return new


def rest(v: np.ndarray) -> np.ndarray:
    """Lengths of what remains of each vector after 0, 1, ... steps of dimensions, rounded upwards."""
    ends = range(0, v.shape[1] + STEP, STEP)
    return np.stack([np.sqrt((v[:, e:] ** 2).sum(1)) * (1 + 1e-6) for e in ends], 1)


def tile_scores(q: np.ndarray, q_rest: np.ndarray, columns: np.ndarray, c_rest: np.ndarray, least: np.ndarray) -> tuple:
    """(query, candidate, score) of all pairs of a tile whose score reaches the query's least one. columns: dimension x candidate."""
    qs, cs = np.arange(len(q)), np.arange(columns.shape[1])
    sums = np.zeros((len(qs), len(cs)), q.dtype)
    pairs = None
    for step, at in enumerate(range(0, q.shape[1], STEP), 1):
        dims = slice(at, at + STEP)
        if pairs is None:
            sums += q[qs, dims] @ columns[dims][:, cs]
            alive = sums + np.outer(q_rest[qs, step], c_rest[cs, step]) >= least[qs, None]
            n = int(np.count_nonzero(alive))
            if n <= SPARSE * alive.size:
                i, j = np.nonzero(alive)
                pairs, sums = (qs[i], cs[j]), sums[i, j]
                continue
            some_q, some_c = alive.any(1), alive.any(0)
            if some_q.mean() * some_c.mean() < 0.75:
                qs, cs, sums = qs[some_q], cs[some_c], sums[np.ix_(some_q, some_c)]
        elif len(pairs[0]):
            i, j = pairs
            for d in range(at, min(at + STEP, q.shape[1])):
                sums += q[i, d] * columns[d][j]
            keep = sums + q_rest[i, step] * c_rest[j, step] >= least[i]
            pairs, sums = (i[keep], j[keep]), sums[keep]
    if pairs is None:
        i, j = np.nonzero(sums >= least[qs, None])
        pairs, sums = (qs[i], cs[j]), sums[i, j]
    return *pairs, sums.astype(np.int64)


class Best:
    """The k best candidates of each query so far, better ones first: by score, then vec_id (null last), then row."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.q = np.zeros(0, np.int64)
        self.score, self.null, self.ids, self.row = self.q, np.zeros(0, bool), self.q, self.q

    def add(self, q: np.ndarray, score: np.ndarray, c: Vectors, j: np.ndarray) -> None:
        if not len(q):
            return
        q = np.concatenate([self.q, q])
        score = np.concatenate([self.score, score])
        null, ids, row = (np.concatenate([old, new[j]]) for old, new in ((self.null, c.null), (self.ids, c.ids), (self.row, c.row)))
        order = np.lexsort((row, ids, null, -score, q))
        q = q[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = order[rank < self.k]
        self.q, self.score, self.null, self.ids, self.row = q[rank < self.k], score[keep], null[keep], ids[keep], row[keep]
        full = q[rank == self.k - 1], score[order[rank == self.k - 1]]
        self.least[full[0]] = np.maximum(self.least[full[0]], full[1])


def searched(queries: Vectors, candidates: Vectors, best: Best) -> None:
    """Brings a block of candidates into the best of all queries."""
    columns = np.ascontiguousarray(candidates.v.T)
    for at in range(0, len(queries.row), TILE):
        part = slice(at, at + TILE)
        i, j, score = tile_scores(queries.v[part], queries.rest[part], columns, candidates.rest, best.least[part])
        other = queries.row[i + at] != candidates.row[j]
        i, j, score = i[other], j[other], score[other]
        if len(i) > 4 * TILE * best.k:  # before a sort: what is below the k-th best of this tile, or tied with it in too many places, goes
            i, j, score = shortened(i, j, score, candidates, best.k)
        best.add(i + at, score, candidates, j)


def shortened(i: np.ndarray, j: np.ndarray, score: np.ndarray, c: Vectors, k: int) -> tuple:
    """The k best pairs of each query, by selection: (score, place among the block's candidates) is one number, 13 bits of it the place."""
    place = np.empty(len(c.row), np.int64)
    place[np.lexsort((c.row, c.ids, c.null))] = np.arange(len(c.row))[::-1]
    key = (score << 13) + place[j]
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if (i[1:] >= i[:-1]).all() else None
    if starts is None:
        order = np.argsort(i, kind="stable")
        i, j, score, key = i[order], j[order], score[order], key[order]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    keep = []
    for a, b in zip(starts, np.r_[starts[1:], len(i)], strict=True):
        keep.append(a + (np.argpartition(key[a:b], b - a - k)[b - a - k :] if b - a > k else np.arange(b - a)))
    keep = np.concatenate(keep)
    return i[keep], j[keep], score[keep]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined and cut to BLOCK rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            table = pa.Table.from_batches(held)
            whole = n - n % BLOCK
            for at in range(0, whole, BLOCK):
                yield table.slice(at, BLOCK)
            held, n = table.slice(whole).to_batches(), n - whole
    if n:
        yield pa.Table.from_batches(held)


# ---- Spark side ----


def first_bounds(queries: DataFrame, seeds, order: np.ndarray, kind: type, k: int) -> DataFrame:
    """row, vec_id, v, least (the k-th best score among the seeds; null if there are fewer) of the queries. seeds: a broadcast table."""

    def run(batches):
        known = None
        for table in blocks(batches):
            known = Vectors(seeds.value, order, kind) if known is None else known
            mine = Vectors(table, order, kind)
            best = Best(len(mine.row), k, np.full(len(mine.row), -np.inf))
            searched(mine, known, best)
            least = pa.array(best.least, mask=np.isinf(best.least))
            yield from table.append_column("least", least).to_batches()

    return queries.mapInArrow(run, "row long, vec_id long, v array<double>, least double")


def block_best(candidates: DataFrame, queries, order: np.ndarray, kind: type, k: int) -> DataFrame:
    """q (row of the query), score, vec_id, row: k of each task for each query at most. queries: a broadcast table."""

    def run(batches):
        mine = best = None
        for table in blocks(batches):
            if mine is None:
                mine = Vectors(queries.value, order, kind)
                best = Best(len(mine.row), k, np.asarray(queries.value.column("least").fill_null(-np.inf)).astype(float))
            searched(mine, Vectors(table, order, kind), best)
        if best is not None:
            for at in range(0, len(best.q), 10_000):
                part = slice(at, at + 10_000)
                ids = pa.array(best.ids[part], mask=best.null[part])
                columns = [pa.array(mine.row[best.q[part]]), pa.array(best.score[part]), ids, pa.array(best.row[part])]
                yield pa.RecordBatch.from_arrays(columns, ["q", "score", "vec_id", "row"])

    return candidates.mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, query_rows: int = QUERY_ROWS, seeds: int = SEEDS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row for which is_query (over vec_id) holds."""
    spark = vectors.sparkSession
    rows = coded(vectors)
    asked = rows.where(is_query).select("row", "vec_id", "v")
    size = rows.agg(F.max("n2"), F.max(F.size("v"))).first()
    n_asked = asked.count()
    out = "query_id long, rank int, vec_id long, score long"
    if not n_asked:
        return spark.createDataFrame([], out)
    if size[0] > LONGEST**2:
        raise ValueError(f"a vector's whole-number length is beyond {LONGEST}: its scores can't be held exactly")
    kind = np.float32 if size[0] < 2**24 else np.float64  # no partial sum of products exceeds the product of two lengths
    # a bounded sample by hash: first bounds, and the order of the dimensions
    sample = rows.select("row", "vec_id", "v").orderBy(F.xxhash64("row")).limit(seeds).toArrow()
    energy = np.zeros(size[1])
    for v in sample.column("v").to_pylist():
        energy[: len(v)] += np.square(v)
    order = np.argsort(-energy, kind="stable")
    n_blocks = -(-n_asked // query_rows)
    known = spark.sparkContext.broadcast(sample)
    dealt = asked.repartition(max(2, spark.sparkContext.defaultParallelism))
    bounded = staged(first_bounds(dealt, known, order, kind, k).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks))), "search-queries")
    known.unpersist()
    path = f"{shared_dir(spark)}/search-found-{uuid4().hex}"
    best_first = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row").asc()]
    for block in range(n_blocks):
        mine = spark.sparkContext.broadcast(bounded.where(F.col("block") == block).drop("block").toArrow())  # about query_rows
        found = block_best(rows.select("row", "vec_id", "v"), mine, order, kind, k)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*best_first))).where(F.col("rank") <= k)
        ranked.write.mode("append").parquet(path)
        mine.unpersist()
    found = spark.read.schema(f"{FOUND}, rank int").parquet(path)
    ids = asked.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"))
    return found.join(ids, "q").select("query_id", "rank", "vec_id", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % QUERY_STEP == 0)


OP11_SQL = """
WITH sound AS (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.rn AS q, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score, c.rn
  FROM sound q JOIN sound c ON q.rn <> c.rn WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id ASC NULLS LAST, rn) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
