"""Corpus pipeline over documents: toxicity, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; its rows are written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import packing, simhash_dedup, substring_dedup, toxicity
from logloom.llm.queries import table, vocabulary
from logloom.llm.runtime import discard_since, saved, ship, tables_made


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose toxicity score is below 0.7, unchanged.

    A row is judged by its own text, so repeated rows stay or go together; null, empty and wordless texts are scored at
    no evidence, and rows with null keys like others. The model learns from labelled rows of ``docs``; without labels of
    both classes it knows one class only. An empty table stays empty.
    """
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), name="__toxicity")
    return scored.where(F.col("__toxicity") < 0.7).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a five-word similarity of 0.8 or more: the one with the least doc_id.

    Rows are grouped by their texts: of repeated rows one stays, and rows with one doc_id and texts that are not alike
    all stay. Null texts, empty ones and those without words are one group. Of a group with null doc_ids alone one row
    stays. An empty table stays empty.
    """
    ship(spark)
    return simhash_dedup.without_near_copies(docs, width=5, similarity=0.8)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without passages of 50 words and more that an earlier document has; n_chars follows the text.

    Null, empty and short texts and rows with null doc_ids stay as they are; rows with equal doc_ids count as one
    document, whose own repeats are not meant. An empty table stays empty.
    """
    ship(spark)
    cut = substring_dedup.without_repeats(docs, min_words=50, similarity=0.8)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return cut


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 4096 tokens.

    Null and empty texts are packed as their end token, repeated rows and null doc_ids each for themselves. An empty
    table gives no pieces.
    """
    ship(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [("toxicity", toxicity_stage), ("simhash_dedup", simhash_stage), ("substring_dedup", substring_stage), ("packing", packing_stage)]
#: The model, the fingerprints and the tokens of the stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. A stage's own tables and its input are deleted when its rows are written."""
    docs, before = table(spark, sf_dir, "documents"), tables_made()
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard_since(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
