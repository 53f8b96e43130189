"""Operator 12, Merkle dataset manifest: an associative monoid of sparse forests, reduced as a tree over partitions.

Leaves are range-partitioned by (source, doc_id) and numbered within their source, so that every partition holds a contiguous stretch of
leaves. A partition's forest has its nodes keyed by tree, level and index; whenever all siblings of a run are there (three, or what a tree of
known size has left at that level) they become their parent, and a source's last node becomes a leaf of the tree of sources. What stays is a
few nodes at the stretch's edges, whatever its length. Forests merge by union and further closing, in any grouping with the same result; the
reduction takes FAN neighbouring forests at a time until one node, the root, is left. It runs as grouped rounds over rows rather than as the
RDD action of that name because the action hands back the last value only: the runs that merging closes are written, as proofs need them.

A proof's siblings come from the leaf's own partition, or from those written runs, which are joined to the partitions whose paths they cross
(a few hundred rows each). The driver sees a row for each partition, and the root.

Defined cases: a null doc_id comes first, is `-` in its leaf, and is never tampered with; rows that are equal are leaves of their own, and
rows that share source and doc_id are ordered by their leaf's hash; a null text stays null when tampered with, and a text without \\n stays
as it is; the empty source is a source after the null one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from binascii import hexlify
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lookup, staged

ARITY = 3
#: Forests that meet in one merge.
FAN = 32
#: Leaves of a partition, about.
PART_ROWS = 100_000
#: The tree of sources; a source's own tree has its rank.
TOP = -1
NODE = "tree long, level int, idx long, hash binary, n long"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(hashes: list[bytes]) -> bytes:
    """The hash of hashes as hex text."""
    return sha256(hexlify(b"".join(hashes))).digest()


def width(n: int, level: int) -> int:
    """Nodes that a tree of n leaves has at a level."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


class Forest:
    """Nodes that wait for their siblings: nodes[tree, level][index] is a hash; sizes[tree] the leaves of the whole tree."""

    def __init__(self, n_sources: int):
        self.nodes: dict[tuple[int, int], dict[int, bytes]] = {}
        self.sizes: dict[int, int] = {TOP: n_sources}

    def put(self, tree: int, level: int, idx: int, value: bytes, n: int) -> None:
        self.sizes[tree] = n
        self.nodes.setdefault((tree, level), {})[idx] = value

    def close(self) -> list[tuple[int, int, int, bytes]]:
        """Turns every run whose siblings are all there into its parent; returns the nodes of those runs."""
        spent = []
        for tree in sorted({t for t, _ in self.nodes} - {TOP}):
            self._close_tree(tree, spent)
        self._close_tree(TOP, spent)  # last: the other trees' last nodes are its leaves
        return spent

    def _close_tree(self, tree: int, spent: list) -> None:
        level, n = 0, self.sizes[tree]
        while True:
            level_nodes = self.nodes.get((tree, level), {})
            if n == 1:
                if tree != TOP and level_nodes:
                    self.put(TOP, 0, tree, level_nodes.pop(0), self.sizes[TOP])
                    self.nodes.pop((tree, level))
                return
            for run in sorted({i // ARITY for i in level_nodes}):
                members = range(run * ARITY, min(n, run * ARITY + ARITY))
                if all(i in level_nodes for i in members):
                    hashes = [level_nodes.pop(i) for i in members]
                    spent += [(tree, level, i, h) for i, h in zip(members, hashes, strict=True)]
                    self.nodes.setdefault((tree, level + 1), {})[run] = digest(hashes)
            if not level_nodes:
                self.nodes.pop((tree, level), None)
            level, n = level + 1, -(-n // ARITY)

    def merge(self, other: Forest) -> Forest:
        """The sum of two forests of different leaves, closed."""
        for key, level_nodes in other.nodes.items():
            self.nodes.setdefault(key, {}).update(level_nodes)
        self.sizes.update(other.sizes)
        self.close()
        return self

    def rows(self) -> list[tuple[int, int, int, bytes, int]]:
        return [(tree, level, i, h, self.sizes[tree]) for (tree, level), level_nodes in self.nodes.items() for i, h in level_nodes.items()]

    def paths(self) -> set[tuple[int, int, int]]:
        """(tree, level, run) of all runs on the way from the waiting nodes to the root."""
        out, up = set(), set()
        for tree in {t for t, _ in self.nodes if t != TOP}:
            self._path(tree, set(), out)
            up.add(tree)
        self._path(TOP, up, out)
        return out

    def _path(self, tree: int, on_way: set[int], out: set) -> None:
        level, n = 0, self.sizes[tree]
        while n > 1:
            on_way = {i // ARITY for i in on_way | set(self.nodes.get((tree, level), {}))}
            out |= {(tree, level, run) for run in on_way}
            level, n = level + 1, -(-n // ARITY)


# ---- inside tasks ----


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _leaves(table: pa.Table, forest: Forest) -> np.ndarray:
    """Puts a partition's leaves into the forest; their order."""
    rank, idx, n = (np.asarray(table.column(c)) for c in ("rank", "idx", "n"))
    order = np.lexsort((idx, rank))
    leaf = table.column("leaf").to_pylist()
    for i in order.tolist():
        forest.put(int(rank[i]), 0, int(idx[i]), leaf[i], int(n[i]))
    return order


def folder(n_sources: int):
    """A partition's leaves -> what its forest keeps (part), and the runs on the ways to the root (hash null)."""

    def fold(table: pa.Table) -> pa.Table:
        forest, part = Forest(n_sources), table.column("part")[0].as_py()
        _leaves(table, forest)
        forest.close()
        rows = [(part, *r) for r in forest.rows()] + [(part, tree, level, run, None, None) for tree, level, run in sorted(forest.paths())]
        return _table(rows, f"part long, {NODE}")

    return fold


def merger(n_sources: int):
    """Neighbouring forests -> their sum (spent false), and the nodes of the runs that it closed (spent true)."""

    def run(table: pa.Table) -> pa.Table:
        forest, group = Forest(n_sources), table.column("part")[0].as_py() // FAN
        for r in table.select(["tree", "level", "idx", "hash", "n"]).to_pylist():
            forest.put(r["tree"], r["level"], r["idx"], r["hash"], r["n"])
        spent = forest.close()
        rows = [(group, *r, False) for r in forest.rows()] + [(group, *r, None, True) for r in spent]
        return _table(rows, f"part long, {NODE}, spent boolean")

    return run


class Paths:
    """Ways from leaves to the root, over the nodes of one partition and of the runs beside it. Leaves are asked for in ascending order."""

    def __init__(self, nodes: dict, sizes: dict, root: bytes):
        self.nodes, self.sizes, self.root = nodes, sizes, root
        self.last_above: dict[tuple[int, int], tuple[int, bytes]] = {}
        self.last_folded: dict[tuple[int, int], tuple[int, bytes]] = {}
        self.widths: dict[tuple[int, int], int] = {}

    def width(self, tree: int, level: int) -> int:
        key = (tree, level)
        if key not in self.widths:
            self.widths[key] = width(self.sizes[tree], level)
        return self.widths[key]

    def siblings(self, tree: int, level: int, idx: int) -> tuple[list[bytes], int]:
        """The whole run that holds a node, and its place there."""
        start = idx - idx % ARITY
        level_nodes = self.nodes[tree, level]
        return [level_nodes[i] for i in range(start, min(self.width(tree, level), start + ARITY))], idx - start

    def above(self, tree: int, level: int, idx: int) -> bytes:
        """Siblings, level by level, from a node to the root."""
        known = self.last_above.get((tree, level))
        if known and known[0] == idx:
            return known[1]
        if self.width(tree, level) == 1:
            value = b"" if tree == TOP else self.above(TOP, 0, tree)
        else:
            run, at = self.siblings(tree, level, idx)
            value = hexlify(b"".join(run[:at] + run[at + 1 :])) + self.above(tree, level + 1, idx // ARITY)
        if level or tree == TOP:
            self.last_above[tree, level] = idx, value
        return value

    def folded(self, tree: int, level: int, idx: int, value: bytes) -> bytes:
        """The root that a node's hash and its siblings give."""
        own = (level or tree == TOP) and self.nodes.get((tree, level), {}).get(idx) == value  # then all below this node share the rest
        known = self.last_folded.get((tree, level))
        if own and known and known[0] == idx:
            return known[1]
        if self.width(tree, level) == 1:
            out = value if tree == TOP else self.folded(TOP, 0, tree, value)
        else:
            run, at = self.siblings(tree, level, idx)
            out = self.folded(tree, level + 1, idx // ARITY, digest(run[:at] + [value] + run[at + 1 :]))
        if own:
            self.last_folded[tree, level] = idx, out
        return out

    def subroot(self, tree: int) -> bytes:
        return self.nodes[TOP, 0][tree]


def prover(n_sources: int, root: bytes):
    """A partition's leaves, and the nodes of the runs beside it -> proofs."""

    def prove(leaves: pa.Table, given: pa.Table) -> pa.Table:
        forest = Forest(n_sources)
        if not leaves.num_rows:
            return _table([], PROOF)
        order = _leaves(leaves, forest).tolist()
        nodes: dict[tuple[int, int], dict[int, bytes]] = {}
        for tree, level, i, h in forest.close():
            nodes.setdefault((tree, level), {})[i] = h
        for tree, level, i, h, _ in forest.rows():
            nodes.setdefault((tree, level), {})[i] = h
        for r in given.select(["tree", "level", "idx", "hash"]).to_pylist():
            nodes.setdefault((r["tree"], r["level"]), {})[r["idx"]] = r["hash"]
        paths, out = Paths(nodes, forest.sizes, root), []
        doc_id, rank, idx, leaf, changed = (leaves.column(c).to_pylist() for c in ("doc_id", "rank", "idx", "leaf", "changed"))
        for i in order:
            tree, at = rank[i], idx[i]
            folded = paths.folded(tree, 0, at, changed[i] or leaf[i])
            proof = sha256(paths.above(tree, 0, at)).hexdigest()
            out.append((doc_id[i], leaf[i].hex(), paths.subroot(tree).hex(), root.hex(), proof, folded.hex(), folded == root))
        return _table(out, PROOF)

    return prove


# ---- Spark side ----


def leaf_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, changed (the tampered leaf, null where it is the same)."""
    doc_id, text, source = F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")
    known = [doc_id, source, F.col("lang").cast("string"), F.col("n_chars").cast("long")]

    def field(c):
        s = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    def leaf(t):
        return F.unhex(F.sha2(F.concat(*map(field, known), field(t)).cast("binary"), 256))

    tampered = (F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0) & text.contains("\n")
    return docs.select(doc_id.alias("doc_id"), source.alias("source"), leaf(text).alias("leaf"), F.when(tampered, leaf(F.replace(text, F.lit("\n"), F.lit("")))).alias("changed"))


def numbered(leaves: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, int, int]:
    """(part, rank (of the source), idx, n (leaves of the source), doc_id, leaf, changed), the parts' numbers' bound, number of sources."""
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // part_rows))
    order = ["source", "doc_id", "leaf", "tie"]
    tied = leaves.withColumn("tie", F.monotonically_increasing_id())  # many equal rows don't have to meet
    placed = tied.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id())
    placed = staged(placed, "merkle-placed").withColumn("part", F.shiftright("at", 33))
    runs = staged(placed.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), "merkle-runs")
    edge = F.struct("first", F.md5(F.col("source").cast("binary")).alias("source"), "n")
    seen = runs.groupBy("part").agg(F.count(F.lit(1)).alias("sources"), F.min(edge).alias("head"), F.max(edge).alias("tail")).orderBy("part").collect()  # a row for each partition
    # a source that goes on over several partitions: how many of its leaves stand before, and how many there are in all
    table, rank, total, before = [], -1, [], []
    carried, previous = 0, object()
    for r in seen:
        same = r.head.source == previous
        carried = carried if same else 0
        rank += 0 if same else 1
        before.append(carried)
        table.append([r.part, rank, r.sources])
        rank += r.sources - 1
        carried = carried + r.tail.n if r.sources == 1 else r.tail.n
        total.append(carried)
        previous = r.tail.source
    head_total, tail_total = [0] * len(seen), [0] * len(seen)
    for k in range(len(seen) - 1, -1, -1):
        goes_on = k + 1 < len(seen) and seen[k + 1].head.source == seen[k].tail.source
        tail_total[k] = head_total[k + 1] if goes_on else total[k]
        head_total[k] = tail_total[k] if seen[k].sources == 1 else before[k] + seen[k].head.n
    rows = [(*t, b, h, e) for t, b, h, e in zip(table, before, head_total, tail_total, strict=True)]
    edges = F.broadcast(spark.createDataFrame(rows, "part long, rank0 long, sources long, before long, head_total long, tail_total long"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    known = runs.withColumn("at", at).join(edges, "part").select(
        F.col("part").alias("run_part"), F.col("source").alias("run_source"), (F.col("rank0") + F.col("at")).alias("rank"),
        (F.when(F.col("at") == 0, F.col("before")).otherwise(0) - F.col("first")).alias("shift"),
        F.when(F.col("at") == 0, F.col("head_total")).when(F.col("at") == F.col("sources") - 1, F.col("tail_total")).otherwise(F.col("n")).alias("n"),
    )
    joined = placed.join(lookup(known), (F.col("part") == F.col("run_part")) & F.col("source").eqNullSafe(F.col("run_source")))
    return joined.select("part", "rank", (F.col("at") + F.col("shift")).alias("idx"), "n", "doc_id", "leaf", "changed"), seen[-1].part + 1 if seen else 0, rank + 1


def reduced(fragments: DataFrame, n_parts: int, n_sources: int) -> tuple[bytes, DataFrame]:
    """The root, and the nodes of all runs that were closed between partitions. fragments: part, tree, level, idx, hash, n."""
    nodes, spent = fragments, None
    while True:
        out = staged(nodes.groupBy((F.col("part") / FAN).cast("long").alias("group")).applyInArrow(merger(n_sources), f"part long, {NODE}, spent boolean"), "merkle-merged")
        closed, nodes = out.where("spent").select("tree", "level", "idx", "hash"), out.where("not spent").drop("spent")
        spent = closed if spent is None else spent.unionByName(closed)
        n_parts = -(-n_parts // FAN)
        if n_parts == 1:
            return bytes(nodes.first().hash), spent


def manifest(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    spark = docs.sparkSession
    leaves = staged(leaf_hashes(docs), "merkle-leaves")
    rows, n_parts, n_sources = numbered(leaves, part_rows)
    if not n_parts:
        return spark.createDataFrame([], PROOF)
    folded = staged(rows.select("part", "rank", "idx", "n", "leaf").groupBy("part").applyInArrow(folder(n_sources), f"part long, {NODE}"), "merkle-fragments")
    root, spent = reduced(folded.where("hash is not null"), n_parts, n_sources)
    needed = folded.where("hash is null").select("part", "tree", "level", F.col("idx").alias("run"))
    given = needed.join(spent.withColumn("run", (F.col("idx") / ARITY).cast("long")), ["tree", "level", "run"]).select("part", "tree", "level", "idx", "hash")
    if n_sources == 1:  # the only subroot is the root, and in no run
        top = [F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(bytearray(root)).alias("hash")]
        given = given.unionByName(needed.select("part").distinct().select("part", *top))
    return rows.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(prover(n_sources, root), PROOF)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LEAF = """sha256(
      coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')
      || coalesce(strlen({text}) || ':' || {text}, '-'))"""
#: crc32 of the decimal doc_id, bit by bit (lowest first): its last bit is what counts.
_CRC = """list_reduce(
      list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
        range(1, 1 + length(CAST(doc_id AS VARCHAR))),
        lambda i: list_transform(range(8), lambda b: (ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INTEGER), 1)) >> CAST(b AS INTEGER)) & 1)))),
      lambda c, bit: xor(c >> 1, CASE WHEN xor(c & 1, bit) = 1 THEN 3988292384 ELSE 0 END))"""
OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf,
    CASE WHEN (4294967295 - {_CRC}) % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS now
  FROM documents
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS rank,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM leaves
), trees AS (
  SELECT 0 AS level, rank, idx, leaf AS h, n FROM placed
  UNION ALL
  SELECT level + 1, rank, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM trees WHERE n > 1 GROUP BY level, rank, idx // 3, n
), tops AS (
  SELECT 0 AS level, rank AS idx, h, count(*) OVER () AS n FROM trees WHERE n = 1
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, idx // 3, n
), nodes AS (
  SELECT rank, level, idx, h, n FROM trees
  UNION ALL SELECT -1, level, idx, h, n FROM tops
), steps AS (
  SELECT 0 AS step, rank * 4294967296 + idx AS leaf_no, rank AS home, rank AS tree, 0 AS level, idx, n, now AS h, '' AS proof FROM placed
  UNION ALL
  SELECT step + 1, leaf_no, home, CASE WHEN n = 1 THEN -1 ELSE tree END, CASE WHEN n = 1 THEN 0 ELSE level + 1 END,
    CASE WHEN n = 1 THEN home ELSE idx // 3 END, CASE WHEN n = 1 THEN (SELECT count(*) FROM tops WHERE level = 0) ELSE (n + 2) // 3 END,
    CASE WHEN n = 1 THEN h ELSE run[1] END, proof || CASE WHEN n = 1 THEN '' ELSE run[2] END
  FROM (
    SELECT s.step, s.leaf_no, s.home, s.tree, s.level, s.idx, s.n, s.h, s.proof,
      [sha256(string_agg(CASE WHEN k.idx = s.idx THEN s.h ELSE k.h END, '' ORDER BY k.idx)),
       coalesce(string_agg(k.h, '' ORDER BY k.idx) FILTER (WHERE k.idx <> s.idx), '')] AS run
    FROM steps s JOIN nodes k ON s.tree = k.rank AND s.level = k.level AND s.idx // 3 = k.idx // 3
    WHERE s.n > 1 OR s.tree >= 0
    GROUP BY s.step, s.leaf_no, s.home, s.tree, s.level, s.idx, s.n, s.h, s.proof
  )
), ends AS (SELECT leaf_no, h, proof FROM steps WHERE tree = -1 AND n = 1),
root AS (SELECT h FROM tops WHERE n = 1)
SELECT doc_id, leaf, trees.h AS subroot, root.h AS root, sha256(ends.proof) AS proof_sha256, ends.h AS folded_root, ends.h = root.h AS verified
FROM (SELECT *, rank * 4294967296 + idx AS leaf_no FROM placed) p
JOIN ends ON ends.leaf_no = p.leaf_no JOIN trees ON trees.rank = p.rank AND trees.n = 1, root
"""
