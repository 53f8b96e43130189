"""Substring search over documents through a stored index of trigrams, built from the table in two batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import search, trigrams
from tidewell.scratch import new_folder
from tidewell.sources.store import Store

from . import query

c = F.col


def _index(t):
    docs = t("documents").select("doc_id", "text", "lang")
    store = Store(docs.sparkSession, new_folder(docs.sparkSession, "index"))
    english = F.coalesce(c("lang") == "en", F.lit(False))
    for batch in (english, ~english):
        trigrams.append(store, docs.where(batch).select("doc_id", "text"), c("text"))
    return store


def _found(t, q):
    parsed = search.parse_query(q)
    return trigrams.search(_index(t), parsed).rows.select("doc_id", search.text_score(parsed, F.lit("")).cast("int").alias("score"))


@query("SELECT doc_id, CAST(6 + 2 + 2 AS INT) AS score FROM documents WHERE contains(lower(text), 'of the') AND contains(lower(text), 'and') AND contains(lower(text), 'ing') AND NOT contains(lower(text), 'license')")
def search_indexed_phrase(t):
    return _found(t, '"of the" and ing -license')


@query("SELECT doc_id, CAST(6 + 2 AS INT) AS score FROM documents WHERE contains(lower(text), 'license, version 2') AND contains(lower(text), 'apache')")
def search_indexed_rare(t):
    return _found(t, '"license, version 2" apache')
