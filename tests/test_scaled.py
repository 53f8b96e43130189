"""Deep pages, large vocabularies, two-stage elections, searches in one scan."""

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import rules
from tidewell.operators import dedupe, pages, search, vocabulary
from tidewell.operators.filters import Filters
from tidewell.schema import LISTING


@pytest.mark.parametrize("down", [(False, False, False), (True, False, True), (False, True, False)])
def test_pages_of_any_depth(spark, down):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "b", "b", "é", "日"]), rng.choice([None, 1.5, 2.5, 2.5, float("nan"), -1.0]) if i % 3 else float(i), i) for i in range(900)]
    df = spark.createDataFrame(rows, "x string, y double, z int").repartition(4)
    keys = list(zip("xyz", down, strict=True))
    whole = [r.z for r in df.orderBy(*(F.desc(k) if d else F.asc(k) for k, d in keys)).collect()]
    for offset, size in ((0, 10), (255, 30), (880, 50), (500, 1), (900, 5), (5000, 5), (100, 400)):
        assert [r.z for r in pages.page(df, keys, offset, size, most=20).collect()] == whole[offset : offset + size], (offset, size)


def test_deep_pages_dont_sort_what_stands_before(spark, tmp_path):
    spark.range(20_000).withColumn("v", F.col("id") * 7919 % 20_011).write.parquet(str(tmp_path / "t"))
    found = pages.page(spark.read.parquet(str(tmp_path / "t")), [("v", False)], 10_000, 25, most=500)
    assert [r.v for r in found.collect()] == sorted(i * 7919 % 20_011 for i in range(20_000))[10_000:10_025]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v," in plan and "LessThan(v," in plan and "rangepartitioning" not in plan
    limits = [int(x) for x in __import__("re").findall(r"TakeOrderedAndProject\(limit=(\d+)", plan)]
    assert limits and max(limits) <= 525


TERMS = [rules.Term("c++", ("c plus plus",)), rules.Term("spark sql"), rules.Term("sql"), rules.Term(".net"), rules.Term("node.js", ("nodejs",)), rules.Term("a b c"), rules.Term("42"), rules.Term("ci/cd")]
TEXTS = [
    "We use C++ and Spark  SQL, spark-sql, SPARK_sql; not sparksql", ".NET and node.js", "node js or nodejs.", "a-b c", "a b\nc 42", "142 42a", "c+", "CI/CD", "ci cd", "", None, "sql", "ésqlé", "Spark sqlite", "c plus  plus", "x.net .netx .net", "sql " * 3000, "no.de", "spark sql",
]


def test_vocabulary_join_finds_what_patterns_find(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    want = {r.id: r.t for r in df.select("id", rules.find_terms(F.col("text"), TERMS, 3).alias("t")).collect() if r.t}
    got = vocabulary.terms_joined(df.repartition(3), "id", F.col("text"), vocabulary.forms_table(spark, TERMS), 3)
    assert {r.id: r.terms for r in got.collect()} == want
    with pytest.raises(ValueError):
        vocabulary.forms_table(spark, [rules.Term("++")])


def test_ten_thousand_terms(spark):
    terms = [rules.Term(f"term{i} x{i % 7}") for i in range(10_000)]
    df = spark.createDataFrame([(i, f"here is term{i * 37} x{i * 37 % 7} and term{i} y") for i in range(200)], "id int, text string")
    got = vocabulary.terms_joined(df, "id", F.col("text"), vocabulary.forms_table(spark, terms))
    assert {r.id: r.terms for r in got.collect()} == {i: [f"term{i * 37} x{i * 37 % 7}"] for i in range(200)}
    assert got._jdf.queryExecution().executedPlan().toString().count("CASE WHEN") < 50


def test_elections_with_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 50}" if i % 7 else None, i % 5 if i % 11 else None, i % 13, i % 17) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string, p int, n int, d int").repartition(6)
    low = lambda x: (x is None, -(x or 0))
    best = {}
    for r in rows:
        key = (low(r[2]), low(r[3]), -r[4], r[0])
        best[r[1]] = min(best.get(r[1], (key, r)), (key, r))
    got = dedupe.elected(df, "g", F.col("p"), F.col("n"), F.timestamp_seconds(F.col("d")), "id")
    assert {r.g: r.id for r in got.collect()} == {g: v[1][0] for g, v in best.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan
    first = dedupe.first_of_group(df, "g", "id", F.col("n"), 4)
    assert {r.g: r["items"] for r in first.collect()} == {g: [r[3] for r in rows if r[1] == g][:4] for g in {r[1] for r in rows}}
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
    assert Counter(r.id for r in dedupe.first_wins(df, ["g"], ["d", "id"]).collect()) == Counter(min((r[4], r[0]) for r in rows if r[1] == g)[1] for g in {r[1] for r in rows})


def listings(spark, n):
    empty = spark.createDataFrame([], LISTING)
    known = {"id": F.col("n").cast("string"), "title": F.concat(F.lit("Job "), F.col("n")), "company": F.lit("Acme"), "description": F.concat(F.lit("long "), F.when(F.col("n") % 2 == 0, "even").otherwise("odd")), "isExpired": F.lit(False), "isPathwayRole": F.lit(False),
             "rankScore": (F.col("n") % 10).cast("int"), "category": F.when(F.col("n") % 4 == 0, "x").otherwise("y"), "postedAt": F.timestamp_seconds(F.col("n") * 1000), "_ord": F.col("n")}
    return spark.range(n).withColumnRenamed("id", "n").select(*((known.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in empty.schema))


def test_searches_scan_listings_once(spark, tmp_path, monkeypatch):
    listings(spark, 400).write.parquet(str(tmp_path / "l"))
    table = spark.read.parquet(str(tmp_path / "l"))
    for deep in (False, True):
        monkeypatch.setattr(search, "DEEP", 50 if deep else 10_000)
        for sort in ("newest", "oldest", "relevance", "salary"):
            found = search.search(table, Filters(q="even", sort=sort, page=4, page_size=25), datetime(2024, 1, 1))
            key = {"newest": lambda n: -n, "oldest": lambda n: n, "salary": lambda n: n, "relevance": lambda n: (-(n % 10), n)}[sort]
            assert found.total == 200 and [int(r.id) for r in found.rows.collect()] == sorted(range(0, 400, 2), key=key)[75:100]
            assert {r.description for r in found.rows.collect()} == {"long even"}
            assert {(r.value, r.n) for r in found.facets.collect() if r.facet == "categories"} == {("x", 100), ("y", 100)}
        assert str(tmp_path / "l") not in found.facets._jdf.queryExecution().executedPlan().toString()
    assert search.search(table, Filters(q="nothing at all"), datetime(2024, 1, 1)).rows.collect() == []


def test_vocabulary_join_looks_at_the_words_beside_a_stretch(spark):
    terms = [rules.Term(".a"), rules.Term("C++", ("c#",)), rules.Term("a-b"), rules.Term("ab cd")]
    rows = [(0, "b.a"), (1, "c++b"), (2, "x .a"), (3, "C++ and c#"), (4, "a-b"), (5, "ab - cd"), (6, "c#1 c#"), (7, None), (8, "..."), (9, "--ab cd")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.terms for r in vocabulary.terms_joined(df, "id", F.col("text"), vocabulary.forms_table(spark, terms)).collect()}
    want = {r.id: r.terms for r in df.select("id", rules.find_terms(F.coalesce("text", F.lit("")), terms).alias("terms")).collect() if r.terms}
    assert got == want and 0 not in got and 1 not in got


def test_stored_listings_are_a_table_of_what_is_read(spark):
    from compare import DATA

    from tidewell.catalog import listings

    rows = listings.stored_listings(lambda name: spark.read.parquet(f"{DATA}/{name}.parquet"), listings._LISTED)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.columns == listings._LISTED and "FileScan parquet" in plan and "InMemoryTableScan" not in plan


def test_keywords_of_one_row_group_are_dealt_out_and_worked_out_once(spark, tmp_path):
    from tidewell.catalog import QUERIES

    rows = [(i, None if i % 50 == 0 else "the with" if i % 50 == 1 else f"word{i} twice twice") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["keywords_top"](spark, str(tmp_path))
    assert {(r.doc_id, r.words) for r in found.collect()} == {(i, f"twice,word{i}") for i in range(400) if i % 50 > 1}
    assert found.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
