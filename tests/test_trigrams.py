"""The trigram index gives what a scan gives, and reads less."""

import random

import pytest
from compare import DATA
from pyspark.sql import functions as F

from tidewell.operators import search, trigrams
from tidewell.scratch import new_folder
from tidewell.sources.store import Store

WORDS = ["alpha", "beta", "Gamma", "délta", "日本語", "x", "zebra crossing", "a\nb", "100%", "😀 ok"]


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))) for i in range(300)] + [(None, "quartz only here"), (None, None), (7, "quartz only here"), (8, ""), (9, "ab")]
    store = Store(spark, new_folder(spark, "test-index"))
    for part in (rows[:150], rows[150:]):
        trigrams.append(store, spark.createDataFrame(part, "id long, text string"), F.col("text"))
    return store, rows


def scanned(rows, query):
    hay = [(i, (t or "").lower()) for i, t in rows]
    return sorted((i is not None, i or 0, t) for i, t in hay if all(x in t for x in query.terms + query.phrases) and not any(x in t for x in query.excluded))


@pytest.mark.parametrize("q", ["zebra", '"zebra crossing" -alpha', "quartz", "nowhere", "x", "délta gamma", "日本語", '"😀 ok" 100%', '"a\nb"', "-beta", "", "al", "BETA"])
def test_same_rows_as_a_scan(index, q):
    store, rows = index
    query = search.parse_query(q)
    assert sorted((r.id is not None, r.id or 0, r.hay) for r in trigrams.search(store, query).rows.collect()) == scanned(rows, query)


def test_rare_words_read_few_parts(index):
    found = trigrams.search(index[0], search.parse_query('"quartz only"'))
    assert found.candidates == 2 and found.parts <= 2
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part#" in plan.split("PartitionFilters")[1][:80]
    assert trigrams.search(index[0], search.parse_query("nowhere")).candidates == 0
    assert trigrams.search(index[0], search.parse_query("al")).candidates is None


def test_slots_are_left_out(index):
    store, _ = index
    plan = store.read("postings").where(trigrams._in_slots({"qua", "uar"}))._jdf.queryExecution().executedPlan().toString()
    files = store.read("postings").where(trigrams._in_slots({"qua", "uar"}))
    assert "PartitionFilters: [slot#" in plan or "PartitionFilters: [isnotnull(slot" in plan or "slot#" in plan.split("PartitionFilters")[1][:120]
    assert files.count() == 4


def test_batches_of_whole_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    store = Store(spark, new_folder(spark, "test-docs"))
    trigrams.append(store, docs.select("doc_id", "text"), F.col("text"))
    n = [store.read(x).count() for x in ("texts", "postings")]
    found = trigrams.search(store, search.parse_query('"apache license"'))
    assert found.rows.count() == docs.where(F.lower("text").contains("apache license")).count() > 0
    assert found.candidates < n[0] < n[1]


def test_only_row_and_gram_are_shuffled(spark):
    df = spark.range(50).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    store = Store(spark, new_folder(spark, "test-narrow"))
    for _ in range(2):
        trigrams.append(store, df, F.col("text"))
    rows = store.read("texts").select("row").collect()
    assert len({r.row for r in rows}) == 100
    # the numbers of a batch lie together, so that they pack
    first = sorted(r.row for r in rows)[:50]
    assert first[-1] - first[0] < 1 << trigrams.BATCH_BITS
    assert store.read("postings").where(F.col("part") != F.pmod("row", F.lit(trigrams.PARTS))).count() == 0
