"""Queries that say conversations in each format of log files and read them back, with what must come out as SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import testdata as t
from .queries import WITH, query


def columns() -> tuple[Column, ...]:
    """session_id, role, text, folder, and time of a message as log formats say them."""
    return F.col("session_id"), F.col("role"), F.col("text"), F.concat(F.lit("/work/"), "project", F.lit("/")), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def record(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items())))


def obj(**fields: Column | str) -> Column:
    return F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()))


def log_files(messages: DataFrame, path: Column, head: Column | None, line: Column) -> DataFrame:
    """A file for each session: path, modificationTime, content; null lines are left out."""
    lines = messages.select(path.alias("path"), "session_id", "seq", (F.lit("") if head is None else F.concat(head, F.lit("\n"))).alias("head"), F.concat(line, F.lit("\n")).alias("line"))
    whole = lines.groupBy("path", "session_id").agg(F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines"))
    content = F.concat("head", F.array_join(F.transform("lines", lambda x: x["line"]), ""))
    return whole.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.encode(content, "UTF-8").alias("content"))


def read_back(raw: DataFrame) -> DataFrame:
    parsed = files.parse_contents(raw)
    return files.messages(parsed).select("session_id", "seq", "source", "project", "role", "text")


def said(source: str, roles: str, session: str = "session_id", project: str = "'/work/' || project") -> str:
    """The same by SQL: messages of some roles in order, without white space round them, empty ones left out."""
    return WITH + f""", b as (select *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as body from conv where role in ({roles}))
select {session} as session_id, cast(row_number() over (partition by session_id order by seq) - 1 as integer) as seq, '{source}' as source, {project} as project, role, body as text from b where body <> ''"""


BOTH, ALL = "'user', 'assistant'", "'user', 'assistant', 'system'"


@query("logs_claude", said("claude", ALL))
def logs_claude(spark: SparkSession, d: str) -> DataFrame:
    said_in, role, said_text, cwd, stamp = columns()
    content = F.array(F.to_json(obj(type="text", text=said_text)), F.to_json(obj(type="tool_use", name="ls")))
    parts = F.from_json(F.concat(F.lit("["), F.array_join(content, ","), F.lit("]")), "array<struct<type:string,text:string,name:string>>")
    line = record(type=role, sessionId=said_in, cwd=cwd, timestamp=stamp, message=obj(role=role, model="m", content=parts))
    return read_back(log_files(t.conversations(spark, d), F.concat(F.lit("/home/u/.claude/projects/x/"), said_in, F.lit(".jsonl")), None, line))


@query("logs_codex", said("codex", ALL))
def logs_codex(spark: SparkSession, d: str) -> DataFrame:
    said_in, role, said_text, cwd, stamp = columns()
    head = record(timestamp=stamp, type="session_meta", payload=obj(id=said_in, cwd=cwd, model="m"))
    kind = F.when(role == "user", "input_text").otherwise("output_text")
    dump = F.lit("[external_agent_tool_call: ls]\nout\n[/external_agent_tool_call]")
    payload = obj(type="message", role=F.when(role == "system", "developer").otherwise(role), content=F.array(obj(type=kind, text=F.concat(dump, said_text)), obj(type=F.lit("image"), text=F.lit("no"))))
    line = F.concat(record(timestamp=stamp, type="response_item", payload=payload), F.lit("\n"), record(timestamp=stamp, type="response_item", payload=obj(type="reasoning", text="hm")))
    return read_back(log_files(t.conversations(spark, d), F.concat(F.lit("/home/u/.codex/sessions/"), said_in, F.lit(".jsonl")), head, line))


@query("logs_muse", said("muse", BOTH))
def logs_muse(spark: SparkSession, d: str) -> DataFrame:
    said_in, role, said_text, cwd, stamp = columns()
    head = record(payload_type="runtime.session.route_facts", stream=obj(id=said_in), payload=obj(record=obj(cwd=cwd)))
    at = F.unix_micros("created_at")
    user = record(payload_type="runtime.user_intent.accepted", stream=obj(id=said_in), recorded_at=at, payload=obj(refill_blocks=F.array(obj(kind="text", text=said_text))))
    reply = record(payload_type="runtime.session", stream=obj(id=said_in), recorded_at=at, payload=obj(event=obj(kind="assistant_message_committed", text=said_text)))
    other = record(payload_type="runtime.tool_batch", stream=obj(id=said_in), recorded_at=at, payload=obj(text=said_text))
    line = F.when(role == "user", user).when(role == "assistant", reply).otherwise(other)
    return read_back(log_files(t.conversations(spark, d), F.concat(F.lit("/home/u/muse/sessions/"), said_in, F.lit("/session.jsonl")), head, line))


@query("logs_cursor", said("cursor", BOTH, project="'cursor:' || project"))
def logs_cursor(spark: SparkSession, d: str) -> DataFrame:
    said_in, role, said_text, cwd, stamp = columns()
    line = F.concat(record(role=role, message=obj(content=F.array(obj(type="text", text=said_text), obj(type="tool_use", text="no")))), F.lit("\n"), record(type="turn_ended", status="success"))
    path = F.concat(F.lit("/home/u/.cursor/projects/"), "project", F.lit("/agent-transcripts/"), said_in, F.lit("/"), said_in, F.lit(".jsonl"))
    return read_back(log_files(t.conversations(spark, d), path, None, line))


@query("logs_antigravity", said("antigravity", BOTH, session="'antigravity:' || session_id", project="''"))
def logs_antigravity(spark: SparkSession, d: str) -> DataFrame:
    said_in, role, said_text, cwd, stamp = columns()
    put = F.concat(F.lit("<USER_REQUEST>"), said_text, F.lit("</USER_REQUEST>\n<ADDITIONAL_METADATA>x</ADDITIONAL_METADATA>"))
    kind = F.when(role == "user", "USER_INPUT").when(role == "assistant", "PLANNER_RESPONSE").otherwise("GENERIC")
    line = record(step_index=F.col("seq"), type=kind, created_at=stamp, thinking="hm", content=F.when(role == "user", put).otherwise(said_text))
    path = F.concat(F.lit("/home/u/.gemini/antigravity/brain/"), said_in, F.lit("/.system_generated/logs/transcript_full.jsonl"))
    return read_back(log_files(t.conversations(spark, d), path, None, line))


@query("logs_dsh", said("dsh", BOTH, session="'dsh:' || session_id"))
def logs_dsh(spark: SparkSession, d: str) -> DataFrame:
    """Each line a frame of its own, and a last one that is torn."""
    said_in, role, said_text, cwd, _ = columns()
    at = F.unix_millis("created_at")
    head = record(type="session", version=F.lit(4), id=said_in, cwd=cwd, createdAt=at)
    parts = F.array(obj(type="text", text=said_text))
    user = record(type="user/message", time=at, data=obj(source=obj(kind="user"), content=parts))
    reply = record(type="assistant/message", time=at, data=obj(message=obj(content=parts)))
    put_in = record(type="user/message", time=at, data=obj(source=obj(kind="context"), content=parts))
    line = F.when(role == "user", user).when(role == "assistant", reply).otherwise(put_in)

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdCompressor()
        for frame in frames:
            yield frame.assign(content=[b"".join(press.compress(x) for x in bytes(c).splitlines(keepends=True)) + press.compress(b'{"type":"us')[:-3] for c in frame["content"]])

    raw = log_files(t.conversations(spark, d), F.concat(F.lit("/home/u/.dsh/sessions/x/"), said_in, F.lit("/session.v4.jsonl.zstd")), head, line)
    return read_back(raw.mapInPandas(packed, raw.schema))


READERS: tuple[Callable, ...] = (logs_claude, logs_codex, logs_muse, logs_cursor, logs_antigravity, logs_dsh)
