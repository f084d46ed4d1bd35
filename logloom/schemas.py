"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, LongType, StringType, StructType, TimestampType

S, I, L, B, T = StringType(), IntegerType(), LongType(), BooleanType(), TimestampType()


def table(*fields: tuple) -> StructType:
    out = StructType()
    for name, kind in fields:
        out = out.add(name, kind)
    return out


SESSIONS = table(("session_id", S), ("source", S), ("project", S), ("started_at", T), ("path", S), ("model", S), ("effort", S), ("updated_at", T))
MESSAGES = table(("session_id", S), ("seq", I), ("source", S), ("project", S), ("role", S), ("text", S), ("created_at", T), ("embedding", ArrayType(FloatType())))
INDEXED = table(("session_id", S), ("seq", I))
POSTINGS = table(("term", S), ("session_id", S), ("seq", I), ("tf", L), ("dl", L), ("project", S), ("source", S), ("context", B))
TERM_DF = table(("project", S), ("term", S), ("msgs", L))
TOPICS = table(("topic_id", S), ("project", S), ("term", S), ("label", S))
TOPIC_EDGES = table(("edge_id", S), ("src_id", S), ("dst_id", S), ("project", S), ("term_a", S), ("term_b", S), ("weight", L), ("kind", S), ("from_term", S), ("to_term", S), ("evidence", S))
MSG_EDGES = table(("session_id", S), ("seq", I), ("project", S), ("term_a", S), ("term_b", S), ("kind", S), ("from_term", S), ("to_term", S), ("evidence", S))
CHECKPOINTS = table(("path", S), ("size", L), ("mtime_ns", L), ("tail_hash", S), ("ends_line", B), ("session_id", S), ("project", S), ("parser_version", I))
COPIES = table(("session_id", S), ("hashes", ArrayType(S)), ("eligible", B), ("imported", B), ("duplicate_of", S), ("seen_at", T))
NO_INGEST = table(("session_id", S), ("path", S), ("tag", S), ("marked_at", T))
ALIASES = table(("old_name", S), ("new_name", S))
IDENTITIES = table(("project", S), ("repo_root", S), ("remote_url", S), ("common_dir", S), ("updated_at", T))
META = table(("key", S), ("value", S))

TABLES = {
    "sessions": SESSIONS, "messages": MESSAGES, "indexed": INDEXED, "postings": POSTINGS, "term_df": TERM_DF, "topics": TOPICS, "topic_edges": TOPIC_EDGES,
    "msg_edges": MSG_EDGES, "file_checkpoints": CHECKPOINTS, "session_copies": COPIES, "no_ingest": NO_INGEST,
    "project_aliases": ALIASES, "project_identities": IDENTITIES, "meta": META,
}
