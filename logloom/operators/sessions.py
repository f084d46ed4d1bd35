"""Sessions as results: titles, endings, windows, references, and recall grouping."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_context, is_prompt
from .filters import EVERYTHING, ProjectFilter, id_starts_with, source_is

REFERENCE = re.compile(r"[\w-]{8,}")


def _prompt() -> Column:
    return is_prompt(F.col("role"), F.col("text"))


def describe(messages: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """session_id, title (first real prompt), messages, last_at: all sessions in one pass."""
    told = messages.groupBy("session_id").agg(
        F.min_by(F.when(_prompt(), F.col("text")), F.when(_prompt(), F.col("seq"))).alias("title"),
        F.count("*").alias("messages"),
        F.max("created_at").alias("newest") if "created_at" in messages.columns else F.lit(None).cast("timestamp").alias("newest"),
    )
    if sessions is None:
        return told.select("session_id", "title", "messages", F.col("newest").alias("last_at"))
    joined = sessions.join(told, "session_id", "left")
    return joined.select(*sessions.columns, "title", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("updated_at", "newest").alias("last_at"))


def endings(messages: DataFrame) -> DataFrame:
    """session_id, seq, role, text: the last real prompt, the last reply, and notes after both."""
    marks = messages.groupBy("session_id").agg(F.max(F.when(_prompt(), F.col("seq"))).alias("lu"), F.max(F.when(F.col("role") == "assistant", F.col("seq"))).alias("la"))
    late = F.coalesce(F.greatest("lu", "la"), F.lit(-1))
    rows = messages.select("session_id", "seq", "role", "text").join(marks, "session_id")
    return rows.where((F.col("seq") == F.col("lu")) | (F.col("seq") == F.col("la")) | ((F.col("role") == "note") & (F.col("seq") > late))).select("session_id", "seq", "role", "text")


def window(messages: DataFrame, session_id: str, first: int, last: int, keep: int = -1, with_context: bool = False) -> DataFrame:
    """A session's messages of a range of seq, without what the host put in except at ``keep``."""
    shown = F.lit(with_context) | (F.col("seq") == keep) | ~is_context(F.col("role"), F.col("text"))
    return messages.where((F.col("session_id") == session_id) & F.col("seq").between(first, last) & shown).orderBy("seq")


def with_prefix(sessions: DataFrame, prefix: str, limit: int = 6) -> DataFrame:
    """Sessions whose id, or its part after the source, begins with the prefix."""
    return sessions.where(id_starts_with(F.col("session_id"), prefix)).select("session_id").orderBy("session_id").limit(limit)


def resolve(sessions: DataFrame, copies: DataFrame, reference: str) -> str:
    """The id that a reference means, or that of the session it is a copy of."""
    found = [r[0] for r in with_prefix(sessions, reference).collect()]
    if reference in found:
        found = [reference]
    if not found:
        raise LookupError(f"no session matches {reference!r}")
    if len(found) > 1:
        raise LookupError(f"session prefix {reference!r} is ambiguous: {', '.join(found)}")
    owner = copies.where((F.col("session_id") == found[0]) & (F.col("duplicate_of") != "")).select("duplicate_of").first()
    return owner[0] if owner else found[0]


def references(query: str) -> list[str]:
    """Words of a query that may be ids or beginnings of ids."""
    return list(dict.fromkeys(w.lower() for w in REFERENCE.findall(query) if re.search("[0-9]", w)))


def named(sessions: DataFrame, query: str, where: ProjectFilter = EVERYTHING, source: str = "") -> list[str]:
    """Sessions that the query names by an id or a beginning that only one session has, in the query's order."""
    wanted = references(query)
    if not wanted:
        return []
    rows = sessions.where(where.column(F.col("project")) & source_is(source, F.col("source")))
    marks = [F.min(F.when(id_starts_with(F.col("session_id"), w, fold=True), F.col("session_id"))).alias(f"a{i}") for i, w in enumerate(wanted)]
    marks += [F.max(F.when(id_starts_with(F.col("session_id"), w, fold=True), F.col("session_id"))).alias(f"b{i}") for i, w in enumerate(wanted)]
    row = rows.agg(*marks).first()
    return list(dict.fromkeys(row[f"a{i}"] for i in range(len(wanted)) if row[f"a{i}"] is not None and row[f"a{i}"] == row[f"b{i}"]))


def group_hits(hits: DataFrame, sessions: int, per_session: int) -> DataFrame:
    """Ranked hits (session_id, seq, score, snippet) by session, in the order of each session's best hit, without
    repeated snippets: adds session_rank and hit_rank. The input is a top list, so one task is enough for it."""
    order = Window.orderBy(F.desc("score"), "session_id", "seq")
    ranked = hits.withColumn("place", F.row_number().over(order))
    once = ranked.withColumn("again", F.row_number().over(Window.partitionBy("session_id", "snippet").orderBy("place"))).where("again = 1")
    each = once.withColumn("hit_rank", F.row_number().over(Window.partitionBy("session_id").orderBy("place"))).withColumn("best", F.min("place").over(Window.partitionBy("session_id")))
    placed = each.withColumn("session_rank", F.dense_rank().over(Window.orderBy("best")))
    return placed.where((F.col("session_rank") <= sessions) & (F.col("hit_rank") <= per_session)).drop("place", "again", "best")
