"""Writes as functions of snapshots: upserts, idempotent inserts, and reconciliation of rewritten sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .postings import KEY

COMPARED = ("seq", "source", "project", "role", "text")


def upsert_sessions(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """New values win, but a known start stays and an update time is set only for new sessions."""
    new = batch.select(*(F.col(c).alias(f"_{c}") for c in stored.columns))
    joined = stored.join(new, F.col("session_id") == F.col("_session_id"), "full_outer")
    fresh = F.col("_session_id").isNotNull()
    out = []
    for c in stored.columns:
        if c == "session_id":
            value = F.coalesce("session_id", "_session_id")
        elif c == "started_at":
            value = F.coalesce("started_at", "_started_at")
        elif c == "updated_at":
            value = F.when(F.col("session_id").isNull(), F.col("_updated_at")).otherwise(F.col("updated_at"))
        else:
            value = F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c))
        out.append(value.alias(c))
    return joined.select(*out)


def set_updated(sessions: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` has session_id and at; a null time changes nothing."""
    rows = sessions.join(changed.select("session_id", "at"), "session_id", "left")
    return rows.withColumn("updated_at", F.coalesce("at", "updated_at")).select(*sessions.columns)


def first_of_each(batch: DataFrame, key: list[str], order: list) -> DataFrame:
    return batch.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def insert_messages(stored: DataFrame, batch: DataFrame, order: list | None = None) -> DataFrame:
    """The batch's rows that are new by (session_id, seq), the first of equals."""
    fresh = batch.join(stored.select(*KEY), KEY, "left_anti")
    return first_of_each(fresh, KEY, order or ["role", "text"])


def ordered(messages: DataFrame, name: str) -> DataFrame:
    body = F.transform(F.array_sort(F.collect_list(F.struct(*COMPARED))), lambda m: F.struct(*(m[c] for c in COMPARED)))
    return messages.groupBy("session_id").agg(body.alias(name))


def classify_sessions(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """session_id, action of each session of the batch: new, same, append (what is stored comes first) or rewrite."""
    rows = ordered(batch, "new").join(ordered(stored, "old"), "session_id", "left")
    n = F.size("old")
    action = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("new"), "same").when((F.size("new") > n) & (F.slice("new", F.lit(1), F.greatest(n, F.lit(0))) == F.col("old")), "append").otherwise("rewrite")
    return rows.select("session_id", action.alias("action"))


def rows_to_add(stored: DataFrame, batch: DataFrame, actions: DataFrame) -> DataFrame:
    """The batch's rows that a store lacks: all of rewritten sessions, and of others those that are new."""
    placed = batch.join(actions, "session_id")
    again = placed.where("action = 'rewrite'").drop("action")
    more = placed.where("action in ('new', 'append')").drop("action").join(stored.select(*KEY), KEY, "left_anti")
    return first_of_each(again.unionByName(more), KEY, ["role", "text"])


def sync_messages(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All messages after the batch, and the action on each of its sessions."""
    actions = classify_sessions(stored.join(batch.select("session_id").distinct(), "session_id", "left_semi"), batch)
    kept = stored.join(actions.where("action = 'rewrite'").select("session_id"), "session_id", "left_anti")
    return kept.unionByName(rows_to_add(stored, batch, actions), allowMissingColumns=True), actions


def fingerprint(table: DataFrame) -> DataFrame:
    """One row: the table's rows and an order-free hash of them."""
    return table.agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(F.xxhash64(*table.columns)), F.lit(0)).alias("row_hash"))
