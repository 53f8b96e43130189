"""Substring search without a scan: a stored table of which rows have which three characters in a row.

The index lies in a store (tidewell.sources.store), so a batch is appended by one commit and a search sees whole batches. Its tables:

* texts: row, the searched text in lower case, and the listing's own columns, by `part` (a hash of row)
* postings: gram, row, part, by `slot` (a hash of gram), sorted by gram, so that a search reads some slots' row groups
* grams: gram and how many rows have it, a row for each batch

A search takes the rarest grams of what must be there, intersects their postings, reads the texts of the parts that have candidates, and
verifies them with the same predicate as a scan. Its result is therefore that of a scan. Where even the rarest gram is in more than SCAN_SHARE
of all rows, or nothing that must be there has three characters, the texts are scanned.

Defined cases: a null text is an empty one; equal rows are rows of their own; ids may be null, as rows are told apart by a number of their
own (two rows that share it by chance are both verified).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.search import Query, matches
from tidewell.scratch import written
from tidewell.sources.store import Manifest, Store

GRAM = 3
PARTS, SLOTS = 64, 64
#: Row numbers of a batch begin at a multiple of this power of two.
BATCH_BITS = 52
#: Grams whose postings are intersected.
MOST_GRAMS = 6
#: Share of all rows above which the rarest gram's postings save nothing.
SCAN_SHARE = 0.25
#: Candidates up to which their row numbers are broadcast.
BROADCAST_ROWS = 20_000
BY = {"texts": ["part"], "postings": ["slot"], "grams": ["slot"]}


@dataclass(frozen=True)
class Found:
    """rows are lazy; candidates and parts say what was read (None: all of it)."""

    rows: DataFrame
    candidates: int | None = None
    parts: int | None = None


def grams_of(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def _slot(gram: Column, n: int) -> Column:
    return F.pmod(F.hash(gram), F.lit(n))


def append(store: Store, rows: DataFrame, hay: Column) -> Manifest:
    """Adds a batch of rows, searchable by `hay` (its lower-case form), in one commit."""
    base = store.manifest()
    # numbers of neighbouring rows are near each other, so that postings pack well; a batch begins far from the one before
    own = F.monotonically_increasing_id() + F.lit(base.version % 2048 << BATCH_BITS)
    # the numbers are fixed by a written table; the searched text is made from it again instead of being written twice
    numbered = written(rows.withColumn("row", own), "texts")
    texts = numbered.select(*rows.columns, F.lower(F.coalesce(hay, F.lit(""))).alias("hay"), "row", F.pmod("row", F.lit(PARTS)).cast("int").alias("part"))
    # a look-ahead finds a gram at every character, in one pass
    every = F.array_distinct(F.regexp_extract_all("hay", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    # only the row and the gram are shuffled: slot and part follow from them
    pairs = texts.select("row", F.explode(every).alias("gram")).repartition(F.pmod(F.hash("gram"), F.lit(7 * SLOTS)))
    slotted = pairs.select("gram", "row", F.pmod("row", F.lit(PARTS)).cast("int").alias("part"), _slot(F.col("gram"), SLOTS).alias("slot"))
    postings = written(slotted.sortWithinPartitions("slot", "gram", "row"), "postings")
    counts = postings.groupBy("slot", "gram").agg(F.count(F.lit(1)).alias("n"))
    return store.commit(base, append={"texts": texts, "postings": postings, "grams": counts}, by=BY)


def rarest(store: Store, at: Manifest, needed: set[str]) -> tuple[dict[str, int], int]:
    """How many rows have each of the needed grams, and how many rows there are."""
    known = store.read("grams", at).where(_in_slots(needed)).groupBy("gram").agg(F.sum("n").alias("n")).collect()  # the query's own grams
    n = {g: 0 for g in needed} | {r.gram: r.n for r in known}
    return n, store.read("texts", at).count()


def _in_slots(grams: set[str]) -> Column:
    """Rows of some grams; the slots are constants, so that other slots' folders aren't opened."""
    constants = F.array(*(_slot(F.lit(g), SLOTS) for g in sorted(grams)))
    return F.array_contains(constants, F.col("slot")) & F.col("gram").isin(sorted(grams))


def search(store: Store, query: Query, at: Manifest | None = None) -> Found:
    """The indexed rows that match: all terms and phrases are substrings, no excluded word is. Columns: the rows' own, and hay."""
    at = at or store.manifest()
    texts = store.read("texts", at)
    if texts is None:
        raise ValueError("the store has no index yet")
    scan = Found(texts.where(matches(query, F.col("hay"))).drop("row", "part"))
    needed = set().union(*(grams_of(x) for x in query.terms + query.phrases))
    if not needed:
        return scan
    counts, n_rows = rarest(store, at, needed)
    chosen = sorted(needed, key=lambda g: (counts[g], g))[:MOST_GRAMS]
    if counts[chosen[0]] > SCAN_SHARE * n_rows:
        return scan
    if not counts[chosen[0]]:
        return Found(texts.limit(0).drop("row", "part"), 0, 0)
    postings = store.read("postings", at).where(_in_slots(set(chosen)))
    both = written(postings.groupBy("row", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= len(chosen)).select("row", "part"), "candidates")
    n_candidates = both.count()
    parts = [r.part for r in both.select("part").distinct().collect()]  # PARTS at most
    rows = both.select("row")
    rows = F.broadcast(rows) if n_candidates <= BROADCAST_ROWS else rows
    read = texts.where(F.col("part").isin(parts)).join(rows, "row", "left_semi")
    return Found(read.where(matches(query, F.col("hay"))).drop("row", "part"), n_candidates, len(parts))
