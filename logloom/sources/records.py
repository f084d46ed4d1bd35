"""Conversations from log records: what every format shares."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from typing import Any

from ..functions.names import clean_path

UNKNOWN = "Unknown"


class UnexpectedFormat(ValueError):
    """A file whose records are not those of its format; it is reported and skipped as a whole."""


def get(record: Any, *path: str) -> str:
    """The string at a path of keys, or the empty string."""
    for key in path:
        record = record.get(key) if isinstance(record, dict) else None
    return record if isinstance(record, str) else ""


def node(record: Any, *path: str) -> dict:
    for key in path:
        record = record.get(key) if isinstance(record, dict) else None
    return record if isinstance(record, dict) else {}


def items(record: Any, key: str) -> list[dict]:
    found = record.get(key) if isinstance(record, dict) else None
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def parts(content: Any, kinds: tuple[str, ...] = ("text",), key: str = "type") -> str:
    """The visible parts of a message, a line each; a string is itself."""
    if isinstance(content, str):
        return content
    if not isinstance(content, list):
        return ""
    return "".join(p["text"] + "\n" for p in content if isinstance(p, dict) and p.get(key) in kinds and isinstance(p.get("text"), str) and p["text"])


_RFC3339 = re.compile(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(\.\d+)?(Z|[+-]\d\d:\d\d)$")


def from_text(value: Any) -> datetime | None:
    m = _RFC3339.match(value) if isinstance(value, str) else None
    if not m:
        return None
    try:
        return datetime.fromisoformat(m[1] + (m[2] or "")[:7] + m[3].replace("Z", "+00:00")).astimezone(UTC)
    except ValueError:
        return None


def from_epoch(value: Any, per_second: int) -> datetime | None:
    """Epoch milliseconds or microseconds; only positive numbers are times."""
    if isinstance(value, bool) or not isinstance(value, int | float) or value <= 0:
        return None
    return datetime.fromtimestamp(0, UTC) + timedelta(microseconds=int(value) * (1_000_000 // per_second))


def stopped(status: str, reason: str) -> str:
    return f"turn {status}: {reason}" if reason else f"turn {status}"


@dataclass
class Conversation:
    """A session and its messages as they are read. Empty texts and adjacent repeats within a second are dropped."""

    source: str
    path: str
    id: str = ""
    project: str = ""
    model: str = ""
    effort: str = ""
    started: datetime | None = None
    updated: datetime | None = None
    newest: datetime | None = None
    messages: list[tuple[int, str, str, datetime | None]] = field(default_factory=list)
    last: tuple[int, str, str, datetime | None] | None = None

    def say(self, role: str, text: str, at: datetime | None = None) -> None:
        text = text.strip()
        if not text:
            return
        if self.last and self.last[1:3] == (role, text) and at and self.last[3] and timedelta(0) <= at - self.last[3] <= timedelta(seconds=1):
            return
        self.last = (self.last[0] + 1 if self.last else 0, role, text, at)
        self.messages.append(self.last)
        self.seen(at)

    def seen(self, at: datetime | None) -> None:
        if at and (self.newest is None or at > self.newest):
            self.newest = at

    def begin(self, at: datetime | None) -> None:
        self.started = self.started or at

    def row(self) -> dict:
        stem = self.path.rpartition("/")[2]
        return {
            "session_id": self.id or stem.rpartition(".")[0] or stem, "source": self.source, "project": clean_path(self.project), "started_at": self.started, "path": self.path,
            "model": self.model or UNKNOWN, "effort": self.effort or UNKNOWN, "updated_at": self.updated or self.newest or self.started,
            "messages": [dict(zip(("seq", "role", "text", "created_at"), m, strict=True)) for m in self.messages],
        }


def json_lines(data: bytes, torn_ok: bool = True) -> Iterator[dict]:
    """Records of a file, in order. A last line without its end is left out if it is cut off; other lines that are not
    JSON objects condemn the file."""
    at = 0
    for line in data.splitlines(keepends=True) if b"\r" not in data else data.replace(b"\r\n", b"\n").split(b"\n"):
        whole = line.endswith(b"\n") or at + len(line) < len(data)
        at += len(line)
        if not (text := line.strip()):
            continue
        try:
            record = json.loads(text)
        except ValueError as e:
            cut = not whole and torn_ok and isinstance(e, json.JSONDecodeError) and e.pos >= len(text.decode(errors="replace").rstrip()) - 1
            if cut or (not whole and torn_ok and "Unterminated" in str(e)):
                return
            raise UnexpectedFormat(f"invalid JSON before byte {at}") from e
        if not isinstance(record, dict):
            raise UnexpectedFormat(f"a record is no object before byte {at}")
        yield record
