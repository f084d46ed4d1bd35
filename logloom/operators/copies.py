"""Copies of sessions across sources, and sessions kept out of memory."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Openings of what hosts put in front of prompts, the marker of imports, and the tags of privacy.
HOST_PREFIXES = ("# AGENTS.md instructions for ", "<environment_context>", "<external_codex_apps_open_page>", "<permissions instructions>", "<collaboration_mode>", "<skills_instructions>")
IMPORT_MARKER = "<EXTERNAL SESSION IMPORTED>"
TAGS = ("private", "noingest", "noduck")
TAG_TRIM = ",:;.!?\\\"'`#()[]{}<>"

_SPACE = r"(?U)^\s+|\s+$"


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), _SPACE, "")


def identities(messages: DataFrame) -> DataFrame:
    """session_id, hashes in order, eligible, imported.

    Code, inner white space, order and notes count; system messages, host openings and bare timestamps do not, and a
    user's text is taken out of its envelope. A session is eligible from three hashes and 500 bytes on, with a prompt
    and a reply of 100 bytes.
    """
    base = normal_text(F.col("text"))
    marker = base == IMPORT_MARKER
    inner = F.regexp_extract(base, r"(?s)^(?:<timestamp>[^<]*</timestamp>\s*)?<user_query>\s*(.*?)\s*</user_query>$", 1)
    wrapped = base.rlike(r"(?s)^(?:<timestamp>[^<]*</timestamp>\s*)?<user_query>\s*(.*?)\s*</user_query>$")
    user = F.col("role") == "user"
    body = F.when(user & wrapped, inner).otherwise(base)
    host = F.lit(False)
    for p in HOST_PREFIXES:
        host = host | F.startswith(F.col("body"), F.lit(p))
    rows = messages.select("session_id", "seq", "role", marker.alias("marker"), body.alias("body"))
    counts = ~F.col("marker") & (F.col("role") != "system") & (F.col("body") != "") & ~(user & (host | F.col("body").rlike(r"^<timestamp>[^<]*</timestamp>$")))
    size = F.octet_length("body")
    digest = F.sha2(F.concat("role", F.char(F.lit(0)), "body"), 256)
    told = rows.withColumn("counts", counts).groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("counts"), F.struct("seq", digest.alias("hash"))))), lambda x: x["hash"]).alias("hashes"),
        F.coalesce(F.sum(F.when(F.col("counts"), size)), F.lit(0)).alias("bytes"),
        F.bool_or(F.col("counts") & (F.col("role") == "user")).alias("has_user"),
        F.bool_or(F.col("counts") & (F.col("role") == "assistant") & (size >= 100)).alias("has_reply"),
        F.bool_or("marker").alias("imported"))
    return told.select("session_id", "hashes", ((F.size("hashes") >= 3) & (F.col("bytes") >= 500) & F.col("has_user") & F.col("has_reply")).alias("eligible"), "imported")


def covered_pairs(sessions: DataFrame) -> DataFrame:
    """copy_id, owner_id: eligible sessions whose hashes begin those of a session of another source in the project.

    ``sessions`` has session_id, source, project, hashes and eligible; the first hash is the join's key.
    """
    rows = sessions.where((F.col("project") != "") & (F.size("hashes") > 0)).withColumn("head", F.col("hashes")[0])
    a = rows.where("eligible").select(F.col("session_id").alias("copy_id"), F.col("source").alias("s1"), F.col("project"), "head", F.col("hashes").alias("h1"))
    b = rows.select(F.col("session_id").alias("owner_id"), F.col("source").alias("s2"), "project", "head", F.col("hashes").alias("h2"))
    pairs = a.join(b, ["project", "head"])
    fit = (F.col("copy_id") != F.col("owner_id")) & (F.col("s1") != F.col("s2")) & (F.size("h1") <= F.size("h2")) & (F.slice("h2", F.lit(1), F.size("h1")) == F.col("h1"))
    return pairs.where(fit).select("copy_id", "owner_id")


def suppress(sessions: DataFrame) -> DataFrame:
    """session_id, duplicate_of of sessions newly found to be copies.

    Greedy within a project and first hash: owners of copies come first and are never suppressed, then sessions without
    an import marker, then by seen_at and id; each is held against those kept so far.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        owners = set(group["owner_id"].dropna())
        group = group.assign(_o=[i not in owners for i in group["session_id"]]).sort_values(["_o", "imported", "seen_at", "session_id"], kind="stable")
        kept: list[tuple[str, str, list]] = []
        out = []
        for row in group.itertuples():
            if row.duplicate_of or not row.eligible:
                continue
            mine = list(row.hashes)
            target = None if row.session_id in owners or not row.project else next((i for i, source, hashes in kept if source != row.source and hashes[: len(mine)] == mine), None)
            if target is None:
                kept.append((row.session_id, row.source, mine))
            else:
                out.append((row.session_id, target))
        return pd.DataFrame(out, columns=["session_id", "duplicate_of"])

    owned = sessions.where("duplicate_of <> ''").select(F.col("duplicate_of").alias("owner_id")).distinct()
    rows = sessions.where(F.size("hashes") > 0).join(owned, F.col("session_id") == F.col("owner_id"), "left").withColumn("head", F.col("hashes")[0])
    return rows.groupBy("project", "head").applyInPandas(fold, "session_id string, duplicate_of string")


def canonical(ids: DataFrame, copies: DataFrame) -> DataFrame:
    """session_id, canonical_id."""
    owners = copies.where("duplicate_of <> ''").select("session_id", "duplicate_of")
    return ids.join(owners, "session_id", "left").select("session_id", F.coalesce("duplicate_of", "session_id").alias("canonical_id"))


def exclusion_tags(messages: DataFrame) -> DataFrame:
    """session_id, tag of sessions whose first prompt opens with a tag of privacy."""
    first = messages.where("role = 'user'").groupBy("session_id").agg(F.min_by("text", "seq").alias("text"))
    word = F.regexp_extract("text", r"(?U)^\s*(\S+)", 1)
    quoted = "".join("\\" + c for c in TAG_TRIM)
    tag = F.lower(F.regexp_replace(word, f"^[{quoted}]+|[{quoted}]+$", ""))
    return first.select("session_id", tag.alias("tag")).where(F.col("tag").isin(*TAGS))


def without(table: DataFrame, session_ids: DataFrame) -> DataFrame:
    return table.join(session_ids.select("session_id"), "session_id", "left_anti")
