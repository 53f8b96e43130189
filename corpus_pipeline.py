"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage but the last returns rows with the columns of documents. ORACLE_SQL is None: perplexity bands and token ids can't be
expressed in SQL, so every stage is tested against a brute-force version on its own input (tests/llm).

The files of the last stage hold the documents in ascending doc_id order, as the encoder's format has it; what the mixing stage's global
shuffle decides is the order of the table it writes.

Defined cases: null and wordless texts fail the quality rules and go; equal rows are near copies of each other, of which one stays; a null
doc_id is kept, its rows are told apart by their words; a null source is a source of its own; columns beside those of documents are carried
through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import ship, staged
from tidewell.llm.decontamination import uncontaminated
from tidewell.llm.mixing import mixed_documents
from tidewell.llm.ngram_join import first_of_each
from tidewell.llm.quality_rules import quality_filter
from tidewell.llm.token_output import token_output


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their language's perplexity band reject go."""
    ship(spark)
    return quality_filter(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship(spark)
    return first_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    ship(spark)
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated towards the sources' target weights, and shuffled."""
    ship(spark)
    return mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written to packed files and read back."""
    ship(spark)
    return token_output(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
