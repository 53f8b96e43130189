"""Operator 4, sharding: longest-processing-time scheduling with a heap, of groups that must stay together.

Equal texts are a group (a row without a text has nothing to keep together and is a group of its own). The groups go, largest first, to the
least-loaded shard. Groups of equal size are interchangeable, so the driver schedules runs of them: a size and how many groups have it.
It sees a row for each distinct size (at most the square root of twice all bytes, as distinct sizes add up to no more than those) and for
each partition. A long run is dealt at once, with the result that the heap has one by one.

Law: bytes. Slots: rows of a shard in the order of doc_id, numbered from 0 without gaps by a range partitioning and a sum over partitions.
Groups of a size are numbered in the same way, by hash, and shards take them in intervals of numbers.

Defined cases: a null text has size 1 and the checksum of no bytes, 0; an empty text likewise; rows with equal doc_ids are rows of their
own, ordered arbitrarily but once; a null doc_id comes first; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, staged

N_SHARDS = 16


def scheduled(runs: list[tuple[int, int]], n_shards: int) -> dict[int, list[tuple[int, int]]]:
    """For runs (size, number of groups): size -> (shard, groups that it takes). Each group, largest first, goes to the least-loaded shard; ties go by shard number."""
    loads, out = [0] * n_shards, {}
    heap = [(0, s) for s in range(n_shards)]
    for size, n in sorted(runs, reverse=True):
        if n <= 4 * n_shards:
            taken: dict[int, int] = {}
            for _ in range(n):
                load, shard = heapq.heappop(heap)
                heapq.heappush(heap, (load + size, shard))
                taken[shard] = taken.get(shard, 0) + 1
                loads[shard] = load + size
            out[size] = sorted(taken.items())
            continue
        # a shard is taken at its load, its load + size, ...: the n least of these values; `level` bounds all but the last of them
        low, high = min(loads), max(loads) + n * size
        below = lambda level: sum(max(0, -(-(level - x) // size)) for x in loads)  # noqa: B023, E731
        while low < high:
            level = (low + high + 1) // 2
            low, high = (level, high) if below(level) <= n else (low, level - 1)
        counts = [max(0, -(-(low - x) // size)) for x in loads]
        left = n - sum(counts)
        for shard in range(n_shards):
            if left and loads[shard] + counts[shard] * size == low:
                counts[shard] += 1
                left -= 1
        loads = [x + c * size for x, c in zip(loads, counts, strict=True)]
        heap = [(x, s) for s, x in enumerate(loads)]
        heapq.heapify(heap)
        out[size] = [(s, c) for s, c in enumerate(counts) if c]
    return out


def _numbered(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """df in the order of the columns over all partitions; `at` has a row's number in its partition in the low 33 bits, the partition's above."""
    return staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), label)


def group_shards(groups: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """g, shard of every group. groups: g, size."""
    spark = groups.sparkSession
    placed = _numbered(groups, ["size", "g"], "groups-placed")
    parts = placed.groupBy(F.shiftright("at", 33).alias("part"), "size").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).collect()  # partitions + distinct sizes at most
    n_of: dict[int, int] = {}
    for r in parts:
        n_of[r["size"]] = n_of.get(r["size"], 0) + r.n
    of_size = scheduled(list(n_of.items()), n_shards)
    rows, before = [], dict.fromkeys(n_of, 0)
    for part, size, n, first in sorted(map(tuple, parts)):
        # a shard takes the groups of this size with numbers below its bound, and not below the one before
        bounds, upto = [], 0
        for _, k in of_size[size]:
            upto += k
            bounds.append(upto)
        rows.append((part, size, before[size] - first, bounds, [s for s, _ in of_size[size]]))
        before[size] += n
    table = lookup(spark.createDataFrame(rows, "part long, size long, shift long, bounds array<long>, shards array<int>"))
    number = F.col("at") + F.col("shift")
    return placed.withColumn("part", F.shiftright("at", 33)).join(table, ["part", "size"]).select("g", F.get("shards", F.size(F.filter("bounds", lambda b: b <= number))).alias("shard"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    raw = F.coalesce(text, F.lit(""))
    group = F.when(text.isNull(), F.xxhash64(F.lit("null"), F.monotonically_increasing_id())).otherwise(F.xxhash64(raw, F.octet_length(raw)))
    rows = staged(docs.select(doc_id.alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), group.alias("g")), "sizes")
    groups = staged(rows.groupBy("g").agg(F.sum("size").alias("size")), "groups")
    # a group of many rows is a hot key on one side only, which adaptive execution splits
    dealt = rows.join(group_shards(groups, n_shards), "g").select("doc_id", "size", "text_crc32", "shard")
    placed = _numbered(dealt, ["shard", "doc_id", "text_crc32"], "placed")
    parts = placed.groupBy(F.shiftright("at", 33).alias("part"), "shard").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).collect()  # partitions + shards at most
    starts, taken = [], dict.fromkeys(range(n_shards), 0)
    for part, shard, n, first in sorted(map(tuple, parts)):
        starts.append((part, shard, taken[shard] - first))
        taken[shard] += n
    shift = F.broadcast(spark.createDataFrame(starts, "part long, shard int, shift long"))
    return placed.withColumn("part", F.shiftright("at", 33)).join(shift, ["part", "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
