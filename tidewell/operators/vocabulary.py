"""Large vocabularies: texts joined with a table of terms by their words, instead of a pattern for each term.

A text's words, and what separates them, are taken once. Every stretch of as many words as some form has is a row (its words in lower case),
joined by equality with the forms; the few that join are verified by the form's own pattern over that stretch and the separators and words beside it,
where any match is one of the text. The plan has one join whatever the number of terms, and the same terms come out as from rules.find_terms.

Defined cases: a null text has no terms; forms without a letter or digit can't be found by words and are an error; a term that several forms
or places give counts once; limit cuts by the vocabulary's order, as the rules do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.rules import Term, term_pattern
from tidewell.functions.text import let

#: Forms up to which the vocabulary is broadcast; a larger one is joined by shuffle.
BROADCAST_FORMS = 200_000
WORD = "[A-Za-z0-9]+"
BREAK = "[^A-Za-z0-9]"
FORMS = "place int, canonical string, words string, n_words int, pattern string"


def forms_table(spark: SparkSession, terms: list[Term]) -> DataFrame:
    """A row for each form: place (of its term in the vocabulary), canonical, words, n_words, pattern."""
    rows = []
    for place, term in enumerate(terms):
        for form in (term.canonical, *term.aliases):
            words = re.findall(WORD, form)
            if not words:
                raise ValueError(f"{form!r} has no word")
            rows.append((place, term.canonical, " ".join(words).lower(), len(words), term_pattern(Term(form))))
    return spark.createDataFrame(rows, FORMS)


def forms_of(terms: DataFrame) -> DataFrame:
    """The same for a table of (place, canonical), whose terms consist of letters, digits and single spaces."""
    words = F.lower("canonical")
    pattern = F.concat(F.lit("(?i)(?<![A-Za-z0-9])(?:"), F.replace("canonical", F.lit(" "), F.lit(r"[\s\-_]+")), F.lit(")(?![A-Za-z0-9])"))
    return terms.select(F.col("place").cast("int").alias("place"), "canonical", words.alias("words"), F.size(F.split(words, " ")).alias("n_words"), pattern.alias("pattern"))


def stretches(text: Column, lengths: list[int]) -> Column:
    """An array of (words, n_words, near) for every stretch of as many words as one of the lengths: words in lower case, near with the separators and words on both sides."""
    text = F.coalesce(text, F.lit(""))
    # the words, and the same words each with what separates it from the next one; what stands before the first word comes with it
    own, pieces = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.regexp_extract_all(text, F.lit(rf"\A{BREAK}*+{WORD}+{BREAK}*+|{WORD}+{BREAK}*+"), F.lit(0))

    def at(x: Column, i: Column, n: int) -> Column:
        words = F.lower(F.concat_ws(" ", *(F.get(x["own"], i + k) for k in range(n))))
        near = F.concat(*(F.coalesce(F.get(x["pieces"], i + k), F.lit("")) for k in range(-1, n + 1)))
        return F.struct(words.alias("words"), F.lit(n).alias("n_words"), near.alias("near"))

    def every(x: Column, n: int) -> Column:
        # there is one word at least; a text of fewer than n has none
        places = F.sequence(F.lit(0), F.greatest(F.size(x["own"]) - n, F.lit(0)))
        return F.when(F.size(x["own"]) >= n, F.transform(places, lambda i: at(x, i, n))).otherwise(none)

    none = F.array().cast("array<struct<words:string,n_words:int,near:string>>")
    return let(F.struct(own.alias("own"), pieces.alias("pieces")), lambda x: F.concat(*(every(x, n) for n in lengths)))


def terms_joined(rows: DataFrame, key: str, text: Column, forms: DataFrame, limit: int = 40) -> DataFrame:
    """key and terms (canonical names in the vocabulary's order, at most limit) of the rows that have any. Keys tell rows apart."""
    known = forms.agg(F.collect_set("n_words"), F.count(F.lit(1))).first()  # a few lengths
    lengths = sorted(known[0]) or [1]
    table = F.broadcast(forms) if known[1] <= BROADCAST_FORMS else forms
    grams = rows.select(F.col(key), F.explode(stretches(text, lengths)).alias("_s")).select(key, "_s.*")
    # a word by itself needs no pattern
    plain = (F.col("n_words") == 1) & (F.lower("canonical") == F.col("words"))
    found = grams.join(table, ["words", "n_words"]).where(plain | F.rlike("near", F.col("pattern"))).select(key, "place", "canonical").distinct()
    # a row has at most as many terms as the vocabulary; of those the first ones stay
    named = F.array_sort(F.collect_list(F.struct("place", "canonical")))
    return found.groupBy(key).agg(F.transform(F.slice(named, 1, limit), lambda x: x["canonical"]).alias("terms"))
