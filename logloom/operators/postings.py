"""The posting list.

A row is a term of a message with its frequency. It also bears the message's length and what searches filter on, so
that a search reads only the postings of its terms and joins nothing before its top rows are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import index_words, is_context, stems

KEY = ["session_id", "seq"]


def build_postings(messages: DataFrame, stemmer: str = "porter") -> DataFrame:
    """term, session_id, seq, tf, dl, project, source, context."""
    words = messages.select(*KEY, "project", "source", is_context(F.col("role"), F.col("text")).alias("context"), stems(index_words(F.col("text")), stemmer).alias("terms"))
    rows = words.select(*KEY, "project", "source", "context", F.size("terms").cast("long").alias("dl"), F.explode("terms").alias("term"))
    counted = rows.groupBy(*KEY, "term", "project", "source", "context", "dl").agg(F.count("*").alias("tf"))  # combined in the map side
    return counted.select("term", *KEY, "tf", "dl", "project", "source", "context")


def term_frequencies(messages: DataFrame, stemmer: str = "porter") -> DataFrame:
    return build_postings(messages, stemmer).select(*KEY, "term", "tf")


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def document_length(postings: DataFrame) -> DataFrame:
    return postings.groupBy(*KEY).agg(F.sum("tf").alias("dl"))


def corpus_stats(messages: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: messages and words of the whole corpus."""
    n = messages.agg(F.count("*").alias("n_messages"))
    return n.join(postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_words")), how="cross")  # one row each


def text_stats(messages: DataFrame) -> DataFrame:
    """The same from texts alone, without a posting list: stems are as many as words."""
    return messages.agg(F.count("*").alias("n_messages"), F.coalesce(F.sum(F.size(index_words(F.col("text"))).cast("long")), F.lit(0)).alias("n_words"))


def append_new(stored: DataFrame, messages: DataFrame, stemmer: str = "porter") -> DataFrame:
    """Postings of messages that have none yet."""
    return build_postings(messages.join(stored.select(*KEY).distinct(), KEY, "left_anti"), stemmer)
