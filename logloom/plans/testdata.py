"""Message tables made from plain tables, for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages; projects and sources follow from the id."""
    rows = read(spark, sf_dir, "conversations")
    conv = F.col("conv_id")
    return rows.select(
        conv.cast("string").alias("session_id"), F.col("turn").cast("int").alias("seq"), F.concat(F.lit("s"), (conv % 3).cast("string")).alias("source"),
        F.concat(F.lit("p"), (conv % 4).cast("string")).alias("project"), "role", F.coalesce("text", F.lit("")).alias("text"), F.timestamp_seconds(F.lit(1_700_000_000) + conv * 3600 + F.col("turn") * 60).alias("created_at"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages of their source, filed under their language."""
    rows = read(spark, sf_dir, "documents")
    return rows.select(F.col("source").alias("session_id"), F.col("doc_id").cast("int").alias("seq"), "source", F.col("lang").alias("project"), F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("session_id"), F.lit(0).alias("seq"), F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("source"), F.concat(F.lit("p"), F.col("label").cast("string")).alias("project"), "embedding")


def sessions(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.first("source").alias("source"), F.first("project").alias("project"), F.min("created_at").alias("started_at"))


CONVERSATIONS = """conv as (
  select cast(conv_id as varchar) as session_id, cast(turn as integer) as seq, 's' || (conv_id % 3) as source, 'p' || (conv_id % 4) as project,
    role, coalesce(text, '') as text, to_timestamp(1700000000 + conv_id * 3600 + turn * 60) as created_at from conversations),
ctx as (select *, (role = 'system' or (role = 'user' and (regexp_matches(text, '^[ \\p{Zs}]*<') or regexp_matches(text, '^[ \\p{Zs}]*# AGENTS.md')))) as context from conv)"""
DOCUMENTS = "docs as (select source as session_id, cast(doc_id as integer) as seq, source, lang as project, 'user' as role, coalesce(text, '') as text from documents)"


def postings_sql(source: str) -> str:
    """CTE ``post`` over a CTE of messages."""
    return f"""w as (select session_id, seq, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) as term from {source}),
post as (select session_id, seq, term, count(*) as tf from w where length(term) between 2 and 40 group by all)"""
