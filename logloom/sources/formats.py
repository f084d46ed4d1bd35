"""The log formats: which file is which, and how its records become a conversation."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable
from pathlib import PurePosixPath

from .records import Conversation, UnexpectedFormat, from_epoch, from_text, get, items, json_lines, node, parts, stopped

#: Parts of paths that tell the formats apart, in order; the first that fits decides.
RULES: tuple[tuple[str, str], ...] = (
    ("cursor_plan", r"\.plan\.md$"),
    ("opencode", r"(^|/)opencode\.db$"),
    ("zcode", r"/\.zcode/(.*/)?db\.sqlite$"),
    ("dsh", r"/\.dsh/sessions/.*\.jsonl\.zstd$"),
    ("antigravity", r"/\.gemini/antigravity/brain/.*/\.system_generated/logs/transcript_full\.jsonl$"),
    ("cursor", r"/agent-transcripts/.*\.jsonl$"),
    ("muse", r"/muse/sessions/(.*/)?session\.jsonl$"),
    ("codex", r"/\.codex/.*\.jsonl$"),
    ("claude", r"/\.claude/projects/.*\.jsonl$"),
)
#: Where the hosts keep their sessions, below the home folder.
ROOTS = (".codex/sessions", ".codex/archived_sessions", ".claude/projects", ".local/share/muse/sessions", ".cursor/projects", ".cursor/plans", ".local/share/opencode/opencode.db", ".zcode/cli/db/db.sqlite", ".dsh/sessions", ".gemini/antigravity/brain")
TOOL_DUMP = re.compile(r"\[external_agent_tool_call:[^\]]*\].*?\[/external_agent_tool_call\]", re.DOTALL)
DSH_VERSION = 4
APPENDABLE = ("codex", "claude", "muse", "cursor", "antigravity")


def classify(path: str) -> str:
    return next((kind for kind, pattern in RULES if re.search(pattern, path)), "")


def default_roots(home: str) -> list[str]:
    return [f"{home.rstrip('/')}/{r}" for r in ROOTS]


def codex(c: Conversation, r: dict) -> None:
    if not get(r, "type") or r.get("payload") is None:
        raise UnexpectedFormat("no type or payload")
    at, kind, p = from_text(r.get("timestamp")), r["type"], node(r, "payload")
    if kind in ("session_meta", "turn_context"):
        c.project = get(p, "cwd") or c.project
        c.id = get(p, "session_id") or (kind == "session_meta" and get(p, "id")) or c.id
        c.model = get(p, "model") or c.model or get(p, "base_instructions", "provenance", "model")
        c.effort = get(p, "reasoning_effort") or get(p, "effort") or c.effort
        if kind == "session_meta":
            c.started = at
    elif kind == "response_item" and p.get("type") == "message":
        role = "system" if get(p, "role") == "developer" else get(p, "role")
        if role in ("user", "assistant", "system") and isinstance(p.get("content"), list):
            c.say(role, TOOL_DUMP.sub("", parts(p["content"], ("input_text", "output_text"))), at)
    elif kind == "event_msg":
        what = p.get("type")
        if what == "task_complete" and get(p, "error", "message"):
            c.say("note", stopped("failed", get(p, "error", "message")), at)
        elif what == "turn_aborted":
            c.say("note", stopped("aborted", get(p, "reason")), at)
        elif what == "item_completed":
            item = node(p, "item")
            role = {"AgentMessage": "assistant", "UserMessage": "user"}.get(get(item, "type"))
            if role and isinstance(item.get("content"), list):
                c.say(role, TOOL_DUMP.sub("", parts(item["content"], ("Text", "text"))), at)


def claude(c: Conversation, r: dict) -> None:
    if not (kind := get(r, "type")):
        raise UnexpectedFormat("no type")
    at, m = from_text(r.get("timestamp")), node(r, "message")
    c.id, c.project = get(r, "sessionId") or c.id, get(r, "cwd") or c.project
    c.begin(at)
    c.model = get(r, "requestedModel") or get(m, "model") or c.model
    c.effort = get(r, "effort") or get(r, "perTurnEffort") or get(m, "output_config", "effort") or c.effort
    if kind in ("user", "assistant") and m:
        c.say(kind, parts(m.get("content")), at)
    elif kind in ("system", "summary"):
        c.say("system", parts(m.get("content") if m else r.get("content")), at)


def muse(c: Conversation, outer: dict) -> None:
    if all(outer.get(k) is None for k in ("payload", "retained_frame", "retained_marker")):
        raise UnexpectedFormat("no payload")
    records = [outer] if "payload" in outer else []
    if get(outer, "retained_frame"):
        records = []
        for child in items(outer, "children"):
            try:
                records.append(json.loads(get(child, "record_json") or "null"))
            except ValueError:
                continue
    for r in records:
        if not isinstance(r, dict):
            continue
        c.id = get(r, "stream", "id") or c.id
        at, kind = from_epoch(r.get("recorded_at"), 1_000_000), get(r, "payload_type")
        c.begin(at)
        p = node(r, "payload")
        said: list[tuple[str, str]] = []
        if kind == "runtime.session.route_facts":
            c.project = get(p, "record", "cwd") or c.project
        elif kind == "runtime.session.metadata":
            c.project = c.project or get(p, "record", "workspace_root")
            c.model = get(p, "record", "model_id") or c.model
        elif kind in ("runtime.user_intent.accepted", "runtime.user_intent.materialized"):
            blocks = [b for m in items(p, "model_messages") for b in items(m, "content")] + items(p, "refill_blocks")
            said = [("user", get(b, "text")) for b in blocks if b.get("kind") == "text"]
        elif kind == "runtime.session":
            e = node(p, "event")
            if e.get("kind") == "started":
                said = [("user", get(e, "prompt"))]
            elif e.get("kind") == "assistant_message_committed":
                said = [("assistant", get(e, "text"))]
            elif e.get("kind") == "inbox_item_queued" and get(e, "source", "source") == "user_steer":
                said = [("user", get(e, "payload", "prompt") if isinstance(e.get("payload"), dict) else get(e, "body"))]
        for role, text in said:
            c.say(role, text, at)


def cursor(c: Conversation, r: dict) -> None:
    if get(r, "type") == "turn_ended":
        if get(r, "status") not in ("success", "completed"):
            c.say("note", stopped(get(r, "status"), get(r, "error")))
        return
    if not get(r, "role") or r.get("message") is None:
        raise UnexpectedFormat("no role or message")
    content = node(r, "message").get("content")
    if r["role"] in ("user", "assistant") and isinstance(content, list):
        c.say(r["role"], parts(content))


def antigravity(c: Conversation, r: dict) -> None:
    if not get(r, "type") or r.get("step_index") is None:
        raise UnexpectedFormat("no type or step_index")
    at = from_text(r.get("created_at"))
    c.begin(at)
    if model := get(r, "model"):
        level = re.fullmatch(r"(.+)-(high|low)", model)
        c.model, c.effort = level.groups() if level else (model, "")
    if r["type"] == "USER_INPUT" and get(r, "source") in ("", "USER_EXPLICIT"):
        c.say("user", typed_prompt(get(r, "content")), at)
    elif r["type"] == "PLANNER_RESPONSE":
        c.say("assistant", get(r, "content"), at)


def typed_prompt(content: str) -> str:
    """What the user typed, without what the host put round it."""
    _, opened, rest = content.partition("<USER_REQUEST>")
    return rest.partition("</USER_REQUEST>")[0] if opened else content.partition("<ADDITIONAL_METADATA>")[0]


def dsh(c: Conversation, r: dict) -> None:
    at, kind, d = from_epoch(r.get("time"), 1000), get(r, "type"), node(r, "data")
    c.seen(at)
    if kind == "session":
        if r.get("version") != DSH_VERSION or not get(r, "id"):
            raise UnexpectedFormat(f"session version {r.get('version')}")
        c.id, c.project, c.started = f"dsh:{get(r, 'id')}", get(r, "cwd"), from_epoch(r.get("createdAt"), 1000)
    elif kind == "model/selection":
        c.model, c.effort = get(d, "model") or c.model, get(d, "reasoningEffort") or c.effort
    elif kind == "request/header":
        c.model, c.effort = c.model or get(d, "header", "config", "model"), c.effort or get(d, "header", "config", "reasoningEffort")
    elif kind == "user/message" and get(d, "source", "kind") == "user":
        c.say("user", parts(d.get("content")) if isinstance(d.get("content"), list) else "", at)
    elif kind == "assistant/message":
        content = node(d, "message").get("content")
        c.say("assistant", parts(content) if isinstance(content, list) else "", at)


STEPS: dict[str, Callable[[Conversation, dict], None]] = {"codex": codex, "claude": claude, "muse": muse, "cursor": cursor, "antigravity": antigravity, "dsh": dsh}


def unzstd(data: bytes) -> tuple[bytes, bool]:
    """The bytes of a stream of frames, and whether its end is missing."""
    import zstandard

    out = []
    try:
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as reader:
            while chunk := reader.read(1 << 16):
                out.append(chunk)
    except zstandard.ZstdError as e:
        if not out:
            raise UnexpectedFormat(f"not a zstd stream: {e}") from e
        return b"".join(out), True
    return b"".join(out), False


def conversation_of(path: str) -> str:
    """The conversation's folder in an antigravity path."""
    m = re.search(r"/brain/([^/]+)/", path)
    return m[1] if m else PurePosixPath(path).parents[2].name


def cursor_project(path: str, folders: dict[str, str]) -> str:
    m = re.search(r"/\.cursor/projects/([^/]*)/", path)
    return (folders.get(m[1]) or f"cursor:{m[1]}") if m else ""


def parse(path: str, data: bytes, kind: str = "", folders: dict[str, dict[str, str]] | None = None, before: Conversation | None = None) -> Conversation:
    """The conversation of a file, or what was appended to one that is known (``before`` has its last message)."""
    kind, folders = kind or classify(path), folders or {}
    name = PurePosixPath(path).name
    if kind == "cursor_plan":
        c = Conversation("cursor", path, id=name.removesuffix(".plan.md"))
        c.say("note", data.decode(errors="replace"))
        return c
    if kind not in STEPS:
        raise UnexpectedFormat(f"unknown kind of file: {path}")
    c = before or Conversation(kind, path)
    if kind == "cursor":
        c.id, c.project = name.removesuffix(".jsonl"), cursor_project(path, folders.get("cursor", {}))
    elif kind == "antigravity":
        c.id, c.project = f"antigravity:{conversation_of(path)}", folders.get("antigravity", {}).get(conversation_of(path), "")
    if kind == "dsh":
        data, _ = unzstd(data)
        data = data[: data.rfind(b"\n") + 1]  # a last line without its end is still being written
    for record in json_lines(data):
        STEPS[kind](c, record)
    if kind == "dsh" and not c.id:
        raise UnexpectedFormat("session header missing")
    return c
