"""Queries of the operators that are built for large tables: deep pages, large vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import pages, vocabulary

from . import query

c = F.col


@query("""
SELECT o_orderkey, o_orderpriority, o_totalprice FROM (
  SELECT *, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) AS place, count(*) OVER () AS n FROM orders)
WHERE place > 2 * n // 3 AND place <= 2 * n // 3 + 40
""")
def page_deep(t):
    """A page at two thirds of an order that many rows tie in."""
    rows = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return pages.page(rows, [("o_orderpriority", True), ("o_totalprice", False), ("o_orderkey", False)], 2 * rows.count() // 3, 40, most=200)


_WORDS = "regexp_extract_all(text, '[A-Za-z0-9]+')"


@query(rf"""
WITH terms AS (
  SELECT item_id * 2 + n - 1 AS place, array_to_string({_WORDS}[1:n], ' ') AS canonical
  FROM benchmark, (SELECT unnest([1, 2]) AS n) WHERE len({_WORDS}) >= n
), firsts AS (SELECT canonical, min(place) AS place FROM terms GROUP BY canonical),
found AS (
  SELECT doc_id, canonical, place FROM documents, firsts
  WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || replace(canonical, ' ', '[\s_-]+') || '($|[^A-Za-z0-9])')
), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM found)
SELECT doc_id, string_agg(canonical, '|' ORDER BY place) AS terms FROM numbered WHERE k <= 40 GROUP BY doc_id
""")
def terms_of_documents(t):
    """The first word, and the first two, of every benchmark item as a vocabulary."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))
    every = t("benchmark").select("item_id", words.alias("w")).select("item_id", "w", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).where(F.size("w") >= c("n"))
    terms = every.select((c("item_id") * 2 + c("n") - 1).alias("place"), F.array_join(F.slice("w", F.lit(1), c("n")), " ").alias("canonical"))
    forms = vocabulary.forms_of(terms.groupBy("canonical").agg(F.min("place").alias("place")))
    found = vocabulary.terms_joined(t("documents"), "doc_id", c("text"), forms)
    return found.select("doc_id", F.array_join("terms", "|").alias("terms"))
