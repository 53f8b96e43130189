"""Operator 8, license scans: diagonal voting of word k-grams against license templates.

All rolling hashes of GRAM words of the whole texts (of fewer, where a template has fewer) are joined with the places of the same hashes in
the templates (a fixed, small table). A match whose words are equal too votes for a diagonal: its place in the document less its place in
the template. Votes are summed by document, template and diagonal; on one diagonal every template place can vote once. Words that were put in
or left out move the diagonal, so neighbouring ones are merged: each that is at most NEAR beyond the one before it goes on with that one's
span, however far a span moves in all. A span is verified by the template's places in it, each taken once, where it first stands: it covers
those that follow the template's place before them in the document, too, on a diagonal at most NEAR away. So a passage that repeats a few
grams of a template many times covers those few only, and one that has them in another order covers little. A span is a find if it covers
enough. Phrases are templates as well, whose words are compared one by one where their first gram votes. Nothing but DataFrame functions runs.

Templates are the notices by which works name their license, and the license texts, one template for each paragraph.

Defined cases: null and wordless texts have no words, places or labels; rows with equal doc_ids are rows of their own; templates and phrases
without words find nothing; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .decontamination import SQL_WORDS, word_array

GRAM = 3
NEAR = 3
COVER = 0.6
#: Fixed phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices by which works name their license.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    # license texts, by paragraph (fixed values)
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("gpl-3", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
]


def _gram(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(words, at + k) for k in range(size)))


def _table(phrases: dict[str, str], templates: list[tuple[str, str]], gram: int) -> list[tuple]:
    """template, label, phrase, words, size (of its grams)."""
    rows = [(label, True, text.split()) for text, label in phrases.items()] + [(label, False, text.split()) for label, text in templates]
    return [(i, label, kind, words, min(gram, len(words))) for i, (label, kind, words) in enumerate(rows) if words]


def template_places(spark: SparkSession, table: list[tuple]) -> DataFrame:
    """gram, size, template, label, phrase, template_words, grams, t: a row for each gram of each template, and one that the end of every document matches."""
    schema = "template int, label string, phrase boolean, template_words array<string>, size int"
    rows = spark.createDataFrame(table, schema).withColumn("grams", F.size("template_words") - F.col("size") + 1)
    places = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)))
    made = None
    for size in sorted({r[-1] for r in table}):
        part = places.where(F.col("size") == size).withColumn("gram", _gram(F.col("template_words"), F.col("t"), size))
        made = part if made is None else made.unionByName(part)
    end = spark.createDataFrame([(-1, None, False, [""], 0, 1, 0)], f"{schema}, grams int, t int").withColumn("gram", F.xxhash64(F.lit("")))
    return end if made is None else made.unionByName(end)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, cover: float = COVER, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, finds (label, first word, cover of each verified span) of every row."""
    rows = _table(phrases, templates, gram)
    table = template_places(docs.sparkSession, rows)  # the templates' words and one row
    text = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", word_array(F.col("text")).alias("words"))
    ended = text.withColumn("n_words", F.size("words").cast("long")).withColumn("words", F.concat("words", F.array(F.lit(""))))
    places = ended.select("row", "doc_id", "n_words", "words", F.posexplode("words").alias("p", "word"))
    sizes = sorted({r[-1] for r in rows} | {gram})
    hashes = [F.xxhash64("word", *(F.get("words", F.col("p") + k) for k in range(1, size))) for size in sizes]
    # the end of a text has one hash, whatever the sizes
    if len(sizes) > 1:
        places = places.withColumn("gram", F.explode(F.when(F.col("word") == "", F.array(hashes[-1])).otherwise(F.array(*hashes))))
    else:
        places = places.withColumn("gram", hashes[0])
    aligned = F.slice("words", F.col("p") + 1, F.col("size")) == F.slice("template_words", F.col("t") + 1, F.col("size"))
    exact = F.when(F.col("phrase") & (F.col("t") == 0), F.slice("words", F.col("p") + 1, F.size("template_words")) == F.col("template_words")).otherwise(False)
    own = ["row", "doc_id", "n_words", "template", "label", "grams", "phrase"]
    diagonal = F.when(F.col("template") < 0, F.lit(0)).otherwise(F.col("p") - F.col("t")).cast("long")
    votes = places.join(F.broadcast(table), "gram").select(*own, "t", diagonal.alias("diagonal"), (aligned | (F.col("template") < 0)).alias("equal"), exact.alias("exact"))
    diagonals = votes.groupBy(*own, "diagonal").agg(F.collect_set(F.when(F.col("equal"), F.col("t"))).alias("places"), F.max("exact").alias("exact"))  # a template's grams at most
    # gaps and islands: a diagonal far from the one before it begins a span; phrases' diagonals stay by themselves
    line = W.partitionBy("row", "template").orderBy("diagonal")
    begins = F.coalesce(F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(line) > NEAR), F.lit(True))
    spans = diagonals.withColumn("begins", begins.cast("int")).withColumn("span", F.sum("begins").over(line))
    # a place of the template, where the span has it first: rows of a span are as many as its template has grams
    every = spans.select(*own, "span", "diagonal", "exact", F.posexplode_outer("places").alias("nth", "t"))
    once = F.when(F.col("exact") & (F.coalesce("nth", F.lit(0)) == 0), F.col("diagonal"))
    firsts = every.groupBy(*own, "span", "t").agg(F.min("diagonal").alias("d"), F.count(once).alias("n_exact"), F.min(once).alias("first_exact"), F.max(once).alias("last_exact"))
    at = F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "d"))))
    merged = firsts.groupBy(*own, "span").agg(at.alias("at"), F.sum("n_exact").alias("n_exact"), F.min("first_exact").alias("first_exact"), F.max("last_exact").alias("last_exact"))
    follows = lambda x, y: (F.abs(y["d"] - x["d"]) <= NEAR) & (y["t"] + y["d"] > x["t"] + x["d"])
    steps = F.size(F.filter(F.zip_with("at", F.slice("at", F.lit(2), F.size("at")), lambda x, y: F.coalesce(follows(x, y), F.lit(False))), lambda ok: ok))
    share = F.when(F.size("at") > 0, (1 + steps) / F.col("grams")).otherwise(0.0)
    merged = merged.withColumn("cover", F.when(F.col("phrase") | (F.col("template") < 0), (F.col("n_exact") > 0).cast("double")).otherwise(share))
    real = (F.col("template") >= 0) & F.when(F.col("phrase"), F.col("n_exact") > 0).otherwise(F.col("cover") >= cover)
    named = merged.withColumn("real", real)
    start = F.greatest(F.coalesce("first_exact", F.get("at", F.lit(0))["d"]), F.lit(0))
    find = F.when(F.col("real"), F.struct("label", start.alias("first_word"), "cover"))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return named.groupBy("row", "doc_id", "n_words").agg(
        F.sum("n_exact").alias("n_base"), F.min("first_exact").alias("first_word"), F.max("last_exact").alias("last_word"), labels(F.col("n_exact") > 0).alias("base_labels"), labels(F.col("real")).alias("labels"),
        F.round(F.coalesce(F.max(F.when(F.col("template") >= 0, F.col("cover"))), F.lit(0.0)), 6).alias("score"), F.array_sort(F.collect_list(find)).alias("finds"),
    ).drop("row")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("finds")


def _sql_lists() -> str:
    return ", ".join(f"({i}, '{label}', {kind}, '{text}')" for i, (label, kind, text) in enumerate([(v, "true", k) for k, v in PHRASES.items()] + [(v, "false", t) for v, t in TEMPLATES]))


OP8_SQL = rf"""
WITH t0 AS (SELECT template, label, phrase, string_split(words, ' ') AS tw, len(string_split(words, ' ')) - {GRAM - 1} AS grams FROM (VALUES {_sql_lists()}) v(template, label, phrase, words)),
tg AS (SELECT template, label, phrase, tw, grams, t, tw[t + 1 : t + {GRAM}] AS g FROM (SELECT *, unnest(range(0, grams)) AS t FROM t0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_WORDS} AS w FROM documents),
dg AS (SELECT rid, w, p, w[p + 1 : p + {GRAM}] AS g FROM (SELECT rid, w, unnest(range(0, greatest(len(w) - {GRAM - 1}, 0))) AS p FROM d)),
votes AS (SELECT rid, template, label, phrase, grams, t, p - t AS diagonal, phrase AND t = 0 AND w[p + 1 : p + len(tw)] = tw AS exact FROM dg JOIN tg USING (g)),
diag AS (SELECT rid, template, label, phrase, grams, diagonal, bool_or(exact) AS exact FROM votes GROUP BY ALL),
islands AS (SELECT rid, template, diagonal, sum(begins) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span
  FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {NEAR} THEN 0 ELSE 1 END AS begins FROM diag WHERE NOT phrase)),
first_at AS (SELECT rid, template, label, grams, span, t, min(diagonal) AS d FROM votes JOIN islands USING (rid, template, diagonal) GROUP BY ALL),
steps AS (SELECT *, abs(d - lag(d) OVER w) <= {NEAR} AND t + d > lag(t + d) OVER w AS follows FROM first_at WINDOW w AS (PARTITION BY rid, template, span ORDER BY t)),
finds AS (
  SELECT rid, label, phrase, CASE WHEN exact THEN 1.0 ELSE 0.0 END AS cover, exact, diagonal FROM diag WHERE phrase
  UNION ALL
  SELECT rid, label, false, (1 + count(*) FILTER (follows)) / any_value(grams), false, NULL FROM steps GROUP BY rid, template, label, span),
per AS (SELECT rid, count(*) FILTER (exact) AS n_base, min(diagonal) FILTER (exact) AS first_word, max(diagonal) FILTER (exact) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (exact)), ',') AS base_labels,
  array_to_string(list_sort(list(DISTINCT label) FILTER (CASE WHEN phrase THEN exact ELSE cover >= {COVER} END)), ',') AS labels,
  round(max(cover), 6) AS score FROM finds GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN per USING (rid)
"""
