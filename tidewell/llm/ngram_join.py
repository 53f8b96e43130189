"""Operator 5, n-gram Jaccard join: a chosen-path join over the sets of five-word shingles, with exact verification.

1. Every whole text becomes its set of shingles (words: runs of 0-9, a-z and non-ASCII after A-Z is lowered; a text of one to four words is
   one shingle). Equal sets are one node, named by a 64-bit hash of the set. A node has a MinHash signature of SIGNATURE values.
2. Chosen paths: the tokens of a node are its signature values with their places (the published algorithm embeds sets so, which makes them
   equally large). In each run, nodes are dealt into buckets by a sampled token; buckets over SMALL are split again by another sampled
   token, and so on to DEPTH. A large bucket's centre (the commonest tokens of about SMALL of its nodes) is compared with all its nodes;
   those near it are linked to the nearest one, and the very near ones leave the bucket, so a group of near copies doesn't stay together
   to be compared pair by pair. Small buckets are compared by brute force, however many nodes they hold.
3. Nodes whose signatures agree in at least CANDIDATE of the values make candidate components. After the first FIRST runs, recall is
   measured: PROBE nodes at a time, chosen by hash, are compared with all nodes until PAIRS pairs are seen (or PROBE_MOST nodes were tried;
   a corpus of no more is compared as a whole), and those that agree in PROBE_AGREE values (fewer than what a pair at the threshold has on
   average, so the measure is a strict one) should be in their components. While less than TARGET of them are, MORE runs are made; a join
   that misses its target after MOST runs fails.
4. Within candidate components, the exact Jaccard similarity of all pairs of nodes is computed, in blocks of BLOCK nodes, and every link of
   `threshold` or more is counted.

Defined cases: null and wordless texts have no shingles, link to nothing and are classes of their own; rows with equal doc_ids are rows of
their own; a null doc_id is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fresh, frugal, mixed, runs, span_hashes, staged, tidy

_LOG = logging.getLogger(__name__)

WORDS = 5
THRESHOLD = 0.8
SIGNATURE = 64
FIRST, MORE, MOST = 6, 4, 42
TARGET = 0.999
PROBE, PROBE_AGREE = 512, 46
#: Pairs that a measure of recall should rest on, and probe nodes that are tried for them.
PAIRS, PROBE_MOST = 2000, 2048
DEPTH = 6
SMALL = 48
CANDIDATE = 38  # of 64: four standard deviations below 0.8
CLOSE = 52  # of 64: leaves a large bucket; what links to it agrees with the centre in 64 * (1 - 12/64 - 0.2) = 39 values on average at worst,
NEAR = 32  # so what agrees in two standard deviations less is linked to the centre's nearest node before that
BLOCK = 512
#: Rows of ids or bucket keys that are broadcast, and of centres; more go through a shuffled join.
ACTIVE_ROWS = 300_000
CENTRES = 20_000

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(5)
_A = _RNG.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) | np.uint64(1)
_C = _RNG.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each document, in order; offsets)."""
    data = _LOWER[data]
    starts, ends = runs(_WORD[data], offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    n = len(offsets) - 1
    word, count = span_hashes(data, starts, ends), np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    length = np.minimum(count, size)
    made = np.where(count > 0, count - length + 1, 0)
    at = np.repeat(first - (np.cumsum(made) - made), made) + np.arange(int(made.sum()))
    own = np.repeat(np.arange(n), made)
    value = length[own].astype(np.uint64)
    padded = np.append(word, np.zeros(size, np.uint64))
    with np.errstate(over="ignore"):
        for k in range(size):
            value = np.where(k < length[own], mixed(value * np.uint64(0x9E3779B97F4A7C15) + padded[at + k]), value)
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    keep = np.ones(len(own), bool)
    keep[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
    own, value = own[keep], value[keep]
    return value, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int64)


def set_hash(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Order-free 64-bit hash of each document's set."""
    sums = np.zeros(len(value) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mixed(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
        return mixed(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def signatures(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each document that has shingles."""
    at = offsets[:-1][np.diff(offsets) > 0]
    out = np.zeros((len(at), SIGNATURE), np.uint32)
    if len(at):
        with np.errstate(over="ignore"):
            for i in range(SIGNATURE):
                out[:, i] = np.minimum.reduceat(((value * _A[i] + _C[i]) >> np.uint64(32)).astype(np.uint32), at)
    return out.view(np.int32)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node (null without shingles), size, sig of every row of docs."""

    def run(batches):
        for batch in batches:
            for at, data, offsets in chunks(batch.column("text")):
                value, bounds = shingles(data, offsets)
                n, has = len(offsets) - 1, np.diff(bounds) > 0
                sig = signatures(value, bounds)
                sizes = np.concatenate([[0], np.cumsum(np.where(has, SIGNATURE, 0))]).astype(np.int32)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(at, n), pa.array(set_hash(value, bounds), mask=~has), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(sig.ravel()))],
                    names=["doc_id", "node", "size", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, node long, size long, sig array<int>")


# ---- chosen paths ----


def _children(key: Column, sig: Column) -> Column:
    """Keys of the buckets below a bucket: one sampled signature value, and a second one in a quarter of the buckets (1 / threshold on average)."""
    a, b = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(SIGNATURE)).cast("int"), F.pmod(F.xxhash64(key, F.lit(2)), F.lit(SIGNATURE)).cast("int")
    child = lambda c: F.xxhash64(key, c, F.get(sig, c))
    return F.when((F.pmod(F.xxhash64(key, F.lit(3)), F.lit(4)) == 0) & (a != b), F.array(child(a), child(b))).otherwise(F.array(child(a)))


def _agree(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda t, v: t + v)


def _grouped(batches, keys: list[str]):
    """Consecutive rows with the same keys, as tables, across batches; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            this = tuple(c[a] for c in cols)
            if held and this != last:
                yield pa.Table.from_batches(held)
                held = []
            last = this
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find that keeps the links that joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def add(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((x, y))


def _brute(batches):
    """Links between nodes of a small bucket whose signatures agree often enough; a spanning forest of each bucket's links."""

    def flush(parts):
        key, node, sig = (np.concatenate(x) for x in zip(*parts, strict=True))
        forest: dict[int, Forest] = {}
        for shift in range(1, len(key)):
            same = np.flatnonzero(key[shift:] == key[:-shift])
            if not len(same):
                break
            hit = same[(sig[same] == sig[same + shift]).sum(axis=1) >= CANDIDATE]
            for k, x, y in zip(key[hit].tolist(), node[hit].tolist(), node[hit + shift].tolist(), strict=True):
                forest.setdefault(k, Forest()).add(x, y)
        found = [e for f in forest.values() for e in f.links]
        return pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        sig = batch.column("sig").flatten().to_numpy().reshape(-1, SIGNATURE)
        held.append((key, node, sig))
        n += len(key)
        if n > 20_000:  # what comes after the last change of key waits for the rest of its bucket
            key, node, sig = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield flush([(key[:cut], node[:cut], sig[:cut])])
            held, n = [(key[cut:], node[cut:], sig[cut:])], len(key) - cut
    if n:
        yield flush(held)


def candidates(nodes: DataFrame, run_ids: range | list[int] = range(FIRST)) -> DataFrame:
    """a, b: links that connect nodes whose signatures agree, from the runs of these numbers. nodes: node, sig."""
    key0 = F.xxhash64(F.col("run"), F.lit("run"))
    rows = nodes.withColumn("run", F.explode(F.array(*(F.lit(i) for i in run_ids)))).select("node", F.explode(_children(key0, F.col("sig"))).alias("key"))
    leaves, links, level = None, None, 0
    while True:
        level += 1
        rows = staged(rows, "paths")
        tidy(nodes.sparkSession)
        buckets = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.sum(F.xxhash64("node") % 1_000_000_007).alias("mark")).where("n > 1"), "buckets")
        # the same small bucket in several runs is compared once
        small = buckets.where(F.col("n") <= SMALL).groupBy("n", "least", "mark").agg(F.min("key").alias("key")).select("key")
        large = buckets.where(F.col("n") > SMALL).select("key", "n")
        n_large = large.count()
        if 0 < n_large <= ACTIVE_ROWS:  # the rows of a hot key then aren't shuffled by it
            large = F.broadcast(large)
        part = (rows.join(large, "key", "left_anti") if n_large else rows).join(small, "key").select("key", "node")
        leaves = part if leaves is None else leaves.unionByName(part)
        if not n_large:
            break
        if level == DEPTH:  # what still is together: blocks of a bucket, each pair of blocks a bucket of its own
            half = SMALL // 2
            blocks = F.ceil(F.col("n") * 1.5 / half).cast("int")
            mine = F.pmod(F.xxhash64("node", F.lit("block")), blocks.cast("long")).cast("int")
            both = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.xxhash64(F.col("key"), F.least(mine, o), F.greatest(mine, o)))
            leaves = leaves.unionByName(rows.join(large, "key").select("node", F.explode(F.array_distinct(both)).alias("key")).select("key", "node"))
            break
        members = rows.join(large, "key")
        some = members.where(F.pmod(F.xxhash64("node", F.lit("centre")), F.ceil(F.col("n") / SMALL).cast("long")) == 0).join(nodes, "node")  # for the centres only: about SMALL of each bucket
        centres = some.groupBy("key").agg(F.array(*(F.mode(F.get("sig", F.lit(i)), True) for i in range(SIGNATURE))).alias("centre"))
        if n_large <= CENTRES:
            centres = F.broadcast(centres)  # a row for each large bucket
        seen = staged(members.join(nodes, "node").join(centres, "key", "left").select("key", "node", "sig", F.coalesce(_agree(F.col("sig"), F.col("centre")), F.lit(0)).alias("same")), "centred")
        near = seen.where(F.col("same") >= NEAR)
        heads = near.groupBy("key").agg(F.max_by("node", F.struct("same", "node")).alias("head"))
        if n_large <= ACTIVE_ROWS:
            heads = F.broadcast(heads)  # a row for each large bucket
        link = near.join(heads, "key").where(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b"))
        links = link if links is None else links.unionByName(link)
        rows = seen.where(F.col("same") < CLOSE).select("node", F.explode(_children(F.col("key"), F.col("sig"))).alias("key"))
    brute = leaves.join(nodes, "node").select("key", "node", "sig").repartition("key").sortWithinPartitions("key").mapInArrow(frugal(_brute), "a long, b long")
    return staged((brute if links is None else brute.unionByName(links)).distinct(), "links")


def probed(nodes: DataFrame, groups: DataFrame) -> tuple[int, int]:
    """(pairs of a probe node and any other node that agree in PROBE_AGREE values, those of them that are in one group).

    PROBE nodes at a time are compared with all nodes, until PAIRS pairs are seen or PROBE_MOST nodes, in a small corpus all, were probes.
    """
    order = F.xxhash64("node", F.lit("probe"))
    every = met = taken = 0
    while every < PAIRS and taken < PROBE_MOST:
        chosen = nodes.orderBy(order).limit(taken + PROBE)
        rows = chosen.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "sig", order.alias("place")).orderBy("place").collect()[taken:]  # PROBE_MOST rows at most
        if not rows:
            break
        seen, together = _compared(nodes, groups, rows)
        every, met, taken = every + seen, met + together, taken + len(rows)
    return every, met


def _compared(nodes: DataFrame, groups: DataFrame, rows: list) -> tuple[int, int]:
    roots, place = np.unique(np.array([r.root for r in rows], np.int64), return_inverse=True)
    own = np.array([r.node for r in rows], np.int64)
    few = (np.array([r.sig for r in rows], np.int32) & 255).astype(np.uint8)  # chance agreement of a value is 1 in 256

    def run(batches):
        for batch in batches:
            node, sig = batch.column("node").to_numpy(), (batch.column("sig").flatten().to_numpy().reshape(-1, SIGNATURE) & 255).astype(np.uint8)
            found = np.zeros((len(node), len(roots)), np.int32)
            for i in range(len(own)):
                found[:, place[i]] += ((sig == few[i]).sum(axis=1) >= PROBE_AGREE) & (node != own[i])
            at, root = np.nonzero(found)
            yield pa.record_batch([pa.array(node[at]), pa.array(roots[root]), pa.array(found[at, root].astype(np.int64))], names=["node", "probe_root", "n"])

    hits = nodes.select("node", "sig").mapInArrow(frugal(run), "node long, probe_root long, n long").join(groups, "node", "left")
    there = F.coalesce("root", "node") == F.col("probe_root")
    r = hits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("every"), F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("met")).first()
    return r.every, r.met


def candidate_groups(nodes: DataFrame, target: float = TARGET, report: dict | None = None) -> DataFrame:
    """node, root of the candidate components, from as many runs as the target recall takes. report: gets runs, probe_pairs and recall."""
    links, done = None, 0
    while True:
        upto = done + (MORE if done else FIRST)
        new = candidates(nodes, range(done, upto))
        links, done = new if links is None else staged(links.unionByName(new).distinct(), "links"), upto
        groups = staged(components(links), "groups")
        tidy(nodes.sparkSession)
        every, met = probed(nodes, groups)
        recall = met / every if every else 1.0
        _LOG.info("n-gram join: %d runs, recall %.5f of %d probe pairs", done, recall, every)
        if report is not None:
            report.update(runs=done, probe_pairs=every, recall=recall)
        if recall >= target:
            return groups
        if done >= MOST:
            raise RuntimeError(f"the join's recall is {recall:.5f} of {every} probe pairs after {done} runs, below its target of {target}")


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component of the links a, b. Large-star and small-star steps in turn."""
    edges = staged(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.join(low, "a").where("b > a and b != m").select(F.col("m").alias("a"), "b").distinct()
        star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b")
        low = star.groupBy("b").agg(F.min("a").alias("m"))
        edges = staged(star.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.least("a", "m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").where("a != b").distinct(), "edges")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


# ---- exact verification ----


def _sets(docs: DataFrame, active: DataFrame) -> DataFrame:
    """node, shingles of the active nodes, from the whole texts read again. active: node, doc_id.

    A doc_id of one active node finds its text by a join. Rows of a null doc_id, or of one that several nodes have, would meet all of those
    nodes there, so their nodes are computed first and joined as such.
    """

    def run(batches):
        for batch in batches:
            for at, data, offsets in chunks(batch.column("text")):
                value, bounds = shingles(data, offsets)
                node, want = set_hash(value, bounds), batch.column("want").slice(at, len(offsets) - 1).to_numpy()
                hit = np.flatnonzero(node == want).tolist()
                raw = value.astype("<u8").tobytes()
                yield pa.record_batch([pa.array(node[hit]), pa.array([raw[8 * bounds[i] : 8 * bounds[i + 1]] for i in hit], pa.binary())], names=["node", "shingles"])

    ids = staged(active.groupBy(F.col("doc_id").alias("want_id")).agg(F.count(F.lit(1)).alias("nodes"), F.first("node").alias("want")), "active")
    plain = (F.col("nodes") == 1) & F.col("want_id").isNotNull()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.join(_small(ids.where(plain).select("want_id", "want")), F.col("doc_id") == F.col("want_id")).select("text", "want")
    several = ids.where(~plain).select("want_id")
    if several.limit(1).collect():
        theirs = rows.join(_small(several), F.col("doc_id").eqNullSafe(F.col("want_id")), "left_semi").select("text")
        wanted = _small(active.select(F.col("node").alias("want_node")))
        found = found.unionByName(_with_nodes(theirs, "want").join(wanted, F.col("want") == F.col("want_node"), "left_semi"))
    return staged(found.mapInArrow(frugal(run), "node long, shingles binary"), "sets").dropDuplicates(["node"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left])
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    sides = []
    for flat, sets in ((a, left), (b, right)):
        spot = np.minimum(np.searchsorted(shared, flat), len(shared) - 1) if len(shared) else np.zeros(len(flat), np.int64)
        ok = shared[spot] == flat if len(shared) else np.zeros(len(flat), bool)
        sides.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok], spot[ok]))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(shared), 8192):
        dense = []
        for (row, col), n in zip(sides, (len(left), len(right)), strict=True):
            part = (col >= at) & (col < at + 8192)
            m = np.zeros((n, min(8192, len(shared) - at)), np.float32)
            m[row[part], col[part] - at] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def spanning(hit: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links (row, column) that connect what the matrix connects; same: rows and columns are the same sets, so it is symmetric. Each row is looked at once, and no list of all hits is made."""
    rows_left = np.ones(hit.shape[0], bool)
    columns_left = rows_left if same else np.ones(hit.shape[1], bool)
    out: list[tuple[int, int]] = []
    for first in np.flatnonzero(hit.any(axis=1)).tolist():
        if not rows_left[first]:
            continue
        rows_left[first] = False
        todo = [(first, True)]
        while todo:
            i, is_row = todo.pop()
            new = np.flatnonzero((hit[i] & columns_left) if is_row else (hit[:, i] & rows_left))
            (columns_left if is_row else rows_left)[new] = False
            out += [(i, j) if is_row else (j, i) for j in new.tolist()]
            todo += [(j, same or not is_row) for j in new.tolist()]
    return out


def _verify(threshold: float):
    def run(batches):
        for table in _grouped(batches, ["job", "x", "y"]):
            x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
            block, node, copies = (table.column(c).to_numpy() for c in ("block", "node", "copies"))
            sets = [np.frombuffer(s, "<u8") for s in table.column("shingles").to_pylist()]
            left = np.flatnonzero(block == x)
            right = left if x == y else np.flatnonzero(block == y)
            if not len(left) or not len(right):
                continue
            size = np.array([len(s) for s in sets], np.float64)
            both = overlaps([sets[i] for i in left], [sets[i] for i in right]).astype(np.float64)
            union = size[left][:, None] + size[right][None, :] - both
            hit = both >= threshold * union - 1e-9
            if x == y:
                np.fill_diagonal(hit, False)
            links = np.zeros(len(node), np.int64)
            links[left] += hit @ copies[right]
            if x != y:
                links[right] += hit.T @ copies[left]
            joined = np.array(spanning(hit, x == y), np.int64).reshape(-1, 2)
            own = np.flatnonzero(links)
            a = np.concatenate([node[own], node[left[joined[:, 0]]]]).astype(np.int64)
            b = np.concatenate([np.zeros(len(own), np.int64), node[right[joined[:, 1]]]]).astype(np.int64)
            n = np.concatenate([links[own], np.zeros(len(joined), np.int64)])
            yield pa.record_batch([pa.array(a), pa.array(b, mask=np.arange(len(a)) < len(own)), pa.array(n)], names=["a", "b", "n"])

    return run


def _classified(docs: DataFrame, threshold: float, target: float, report: dict | None = None) -> DataFrame:
    """What near_duplicates returns, and root: the node that names the class (null without shingles)."""
    all_rows = staged(sketches(docs), "sketches")
    nodes = staged(all_rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")), "nodes")
    groups = candidate_groups(nodes.select("node", "sig"), target, report)
    sizes = staged(groups.groupBy("root").agg(F.count(F.lit(1)).alias("m")), "sizes")
    active = staged(groups.join(_small(sizes), "root").join(nodes.select("node", "doc_id", "copies"), "node"), "members")
    sets = _sets(docs, active)
    n_blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit("verify")), n_blocks.cast("long")).cast("int")
    jobs = (
        active.select(F.col("root").alias("job"), "node", "copies", block.alias("block"), n_blocks.alias("n_blocks"))
        .join(sets, "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select("job", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "copies", "shingles")
    )
    found = staged(jobs.repartition("job", "x", "y").sortWithinPartitions("job", "x", "y").mapInArrow(frugal(_verify(threshold)), "a long, b long, n long"), "verified")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    of_node = staged(nodes.select("node", "doc_id", "copies").join(links, "node", "left").join(roots, "node", "left").select("node", "root", "doc_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "node-classes")
    least = staged(of_node.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id")), "least")
    by_node = of_node.join(_small(least), "root", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "doc_id").alias("class_id"), "n_links")
    out = all_rows.select("doc_id", "node").join(by_node, "node", "left")
    return out.select("doc_id", "node", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET, report: dict | None = None) -> DataFrame:
    """doc_id, node, class_id, n_links for each row of docs. class_id: the least doc_id of the documents that links connect; n_links: other documents at least `threshold` similar, copies included. report: gets the runs made and the recall measured."""
    return _classified(docs, threshold, target, report).drop("root")


def _with_nodes(docs: DataFrame, column: str) -> DataFrame:
    """docs and the node of each row, in `column`."""
    text = fresh("text_in", [*docs.columns, column])

    def run(batches):
        for batch in batches:
            parts = []
            for _, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                value, bounds = shingles(data, offsets)
                parts.append(pa.array(set_hash(value, bounds), mask=np.diff(bounds) == 0))
            if parts:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.concat_arrays(parts)], names=[*batch.schema.names[:-1], column])

    return docs.withColumn(text, F.col("text").cast("string")).mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())]))


def _small(table: DataFrame) -> DataFrame:
    """A table of ids, marked for broadcast if it is small."""
    return F.broadcast(table) if table.count() <= ACTIVE_ROWS else table


def first_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class of near copies, that of its least doc_id (null ids come last) and then node, with its own columns; rows without words stay.

    An id that one row has decides by itself; rows without an id, and those of an id that several rows have, are told apart by their nodes.
    """
    found = staged(_classified(docs, threshold, TARGET), "classes")
    own_id, first_id, node, first_node = (fresh(x, docs.columns) for x in ("own_id", "first_id", "own_node", "first_node"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node"))
    firsts = staged(found.where("node is not null").groupBy("root").agg(least.alias("first")).select("first.doc_id", "first.node"), "firsts")
    ids = staged(found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("node").alias("node")), "ids")
    dropped = ids.where("n = 1 and node is not null").join(firsts, ["doc_id", "node"], "left_anti")
    marks = staged(dropped.unionByName(ids.where("n > 1").select("doc_id", "node", "n")).select(F.col("doc_id").alias(own_id), (F.col("n") > 1).alias("several")), "marks")
    numbered = docs.where(F.col("doc_id").cast("long").isNotNull())
    same = F.col("doc_id").cast("long") == F.col(own_id)
    kept = numbered.join(_small(marks.select(own_id)), same, "left_anti")
    several = marks.where("several").select(own_id)
    if not several.limit(1).collect() and not found.where("doc_id is null").limit(1).collect():
        return kept
    unclear = docs.where(F.col("doc_id").cast("long").isNull()).unionByName(numbered.join(_small(several), same, "left_semi"))
    rows = staged(_with_nodes(unclear, node), "unclear")
    once = rows.where(F.col(node).isNotNull()).withColumn(own_id, F.col("doc_id").cast("long")).dropDuplicates([own_id, node])
    chosen = _small(firsts.select(F.col("doc_id").alias(first_id), F.col("node").alias(first_node)))
    ours = once.join(chosen, F.col(own_id).eqNullSafe(F.col(first_id)) & (F.col(node) == F.col(first_node)), "left_semi")
    return kept.unionByName(rows.where(F.col(node).isNull()).select(*docs.columns)).unionByName(ours.select(*docs.columns))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")
