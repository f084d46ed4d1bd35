"""BM25, exact vector ranking, and their fusion."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import index_words, stems
from ..functions.vectors import cosine_distance
from .filters import EVERYTHING, ProjectFilter, source_is
from .postings import KEY

K1, B, RRF = 1.2, 0.75, 60
MAX_DISTANCE = 0.65
EXPANSION_WEIGHT = 0.3
PLACES = 12  # ranks compare scores rounded to so many places, as sums come in any order


def query_terms(spark, query: str, stemmer: str = "porter") -> list[str]:  # noqa: ANN001
    """The distinct terms of a query, made like the postings."""
    row = spark.createDataFrame([(query,)], "q string").select(F.array_sort(F.array_distinct(stems(index_words(F.col("q")), stemmer))).alias("t")).first()
    return row["t"] or []


def _weights(weights: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable((t, float(w)) for t, w in weights.items()))), F.col("term"))


def bm25_scores(postings: DataFrame, n_messages: Column, n_words: Column, stats: DataFrame, weights: dict[str, float], where: ProjectFilter = EVERYTHING, source: str = "") -> DataFrame:
    """session_id, seq, score of every message with a term; document frequencies count all messages, and what the host
    put in is never a hit. ``weights`` is a query's few terms, which prune the scan."""
    hits = postings.where(F.col("term").isin(*weights))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    small = F.broadcast(df)  # a row for each term of the query
    rows = hits.where(~F.col("context") & where.column(F.col("project")) & source_is(source, F.col("source"))).join(small, "term").join(F.broadcast(stats), how="cross")
    idf = F.log(1 + (n_messages - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = K1 * (1 - B + B * F.col("dl") / (n_words / n_messages))
    return rows.groupBy(*KEY).agg(F.sum(_weights(weights) * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + length)).alias("score"))


def keyword_rank(postings: DataFrame, stats: DataFrame, weights: dict[str, float], limit: int, where: ProjectFilter = EVERYTHING, source: str = "") -> DataFrame:
    scored = bm25_scores(postings, F.col("n_messages"), F.col("n_words"), stats, weights, where, source)
    return scored.withColumn("score", F.round("score", PLACES)).orderBy(F.desc("score"), *KEY).limit(limit)


def vector_rank(messages: DataFrame, vector: list[float], limit: int, where: ProjectFilter = EVERYTHING, source: str = "", cutoff: float = MAX_DISTANCE) -> DataFrame:
    """session_id, seq, distance of the nearest messages: the limit first, then the cutoff."""
    rows = messages.where(F.col("embedding").isNotNull() & where.column(F.col("project")) & source_is(source, F.col("source")))
    told = F.array(*(F.lit(round(float(x), 6)) for x in vector))
    near = rows.select(*KEY, F.round(cosine_distance(F.col("embedding"), told), PLACES).alias("distance")).orderBy("distance", *KEY).limit(limit)
    return near.where(F.col("distance") <= cutoff)


def reciprocal_ranks(ranked: DataFrame, order: Column) -> DataFrame:
    """1 / (60 + rank) with ties sharing a rank; the input is a top list, so one task is enough for it."""
    return ranked.select(*KEY, (1.0 / (RRF + F.rank().over(Window.orderBy(order)))).alias("part"))


def fuse(keyword: DataFrame, vector: DataFrame | None) -> DataFrame:
    """session_id, seq, score: the vector list only reorders what the keywords found."""
    parts = reciprocal_ranks(keyword, F.desc("score"))
    if vector is not None:
        parts = parts.unionByName(reciprocal_ranks(vector.join(keyword.select(*KEY), KEY, "left_semi"), F.asc("distance")))
    return parts.groupBy(*KEY).agg(F.sum("part").alias("score"))


def hybrid_rank(messages: DataFrame, postings: DataFrame, stats: DataFrame, terms: list[str], vector: list[float] | None, limit: int, expand: tuple[str, ...] = (), where: ProjectFilter = EVERYTHING, source: str = "") -> DataFrame:
    """The fused ranking; terms of the graph weigh less than the query's own."""
    if limit < 1:
        raise ValueError("limit must be positive")
    if not terms:
        raise ValueError("query has no searchable terms")
    weights = dict.fromkeys(terms, 1.0) | dict.fromkeys(expand, EXPANSION_WEIGHT)
    keyword = keyword_rank(postings, stats, weights, max(limit * 10, 500), where, source)
    near = vector_rank(messages, vector, max(limit * 5, 50), where, source) if vector else None
    return fuse(keyword, near).orderBy(F.desc("score"), *KEY).limit(limit)
