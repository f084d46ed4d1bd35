"""Live SQLite stores, read in one read-only transaction, as a Spark data source and as functions."""

from __future__ import annotations

import contextlib
import json
import re
import sqlite3
from collections.abc import Iterator
from pathlib import PurePosixPath
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.names import clean_path
from .formats import classify
from .records import Conversation, UnexpectedFormat, from_epoch

ROW = "session_id string, source string, project string, started_at timestamp, path string, model string, effort string, updated_at timestamp, messages array<struct<seq:int,role:string,text:string,created_at:timestamp>>"


@contextlib.contextmanager
def reading(path: str) -> Iterator[sqlite3.Connection]:
    db = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    try:
        db.execute("begin")
        yield db
    finally:
        db.close()


def _rows(db: sqlite3.Connection, sql: str, old_sql: str, since: int) -> list[tuple]:
    """The query's rows, or those of a store whose tables lack the newer columns."""
    try:
        return db.execute(sql, (since, since)).fetchall()
    except sqlite3.OperationalError as e:
        if "no such column" not in str(e):
            raise UnexpectedFormat(str(e)) from e
    try:
        return db.execute(old_sql).fetchall()
    except sqlite3.OperationalError as e:
        raise UnexpectedFormat(str(e)) from e


def _object(data: str, where: str) -> dict:
    try:
        found = json.loads(data)
    except (TypeError, ValueError) as e:
        raise UnexpectedFormat(f"a record of {where} is no JSON") from e
    return found if isinstance(found, dict) else {}


def _say(c: Conversation, role: str, text: str, at: int) -> None:
    """Messages of stores are numbered as they come, repeats too."""
    if role in ("user", "system", "assistant") and text:
        c.last = None if c.last is None else (c.last[0], "", "", None)
        c.say(role, text, from_epoch(at, 1000))


def opencode(path: str, since: int = 0) -> list[Conversation]:
    """Sessions changed at ``since`` (epoch milliseconds) or later; all for 0."""
    out = []
    with reading(path) as db:
        base = "select s.id, coalesce(nullif(s.directory, ''), p.worktree, ''), s.time_created{} from session_v2 s left join project p on p.id = s.project_id {} order by s.time_created, s.id"
        for row in _rows(db, base.format(", s.model, s.time_updated", "where ? = 0 or coalesce(s.time_updated, s.time_created) >= ?"), base.format("", ""), since):
            model = {}
            with contextlib.suppress(TypeError, ValueError):
                model = json.loads(row[3]) if len(row) > 3 and row[3] else {}
            model = model if isinstance(model, dict) and model.get("id") else {}
            c = Conversation("opencode", path, f"opencode:{row[0]}", row[1], model.get("id") or "", model.get("variant") or "", from_epoch(row[2], 1000))
            c.updated = from_epoch(row[4], 1000) if len(row) > 4 else None
            for kind, data, at in db.execute("select type, data, time_created from session_message where session_id = ? order by seq, id", (row[0],)):
                if kind in ("user", "system", "assistant"):
                    m = _object(data, c.id)
                    said = [m.get("text") or ""] if kind != "assistant" else [p.get("text") or "" for p in m.get("content") or [] if isinstance(p, dict) and p.get("type") == "text"]
                    _say(c, kind, "\n".join(t.strip() for t in said if t.strip()), at)
            c.updated = c.updated or c.started
            out.append(c)
    return out


def zcode(path: str, since: int = 0) -> list[Conversation]:
    out = []
    with reading(path) as db:
        base = "select id, coalesce(directory, ''), time_created{} from session {} order by time_created, id"
        for row in _rows(db, base.format(", time_updated", "where ? = 0 or coalesce(time_updated, time_created) >= ?"), base.format("", ""), since):
            c = Conversation("zcode", path, f"zcode:{row[0].removeprefix('sess_')}", row[1], started=from_epoch(row[2], 1000))
            c.updated = from_epoch(row[3], 1000) if len(row) > 3 else None
            with contextlib.suppress(sqlite3.OperationalError, UnexpectedFormat):
                entry = db.execute("select data from session_entry where session_id = ? and type = 'runtime/model_selection' order by time_created desc limit 1", (row[0],)).fetchone()
                chosen = _object(entry[0], c.id).get("modelSelection") or {} if entry else {}
                c.model, c.effort = chosen.get("modelId") or "", (chosen.get("options") or {}).get("reasoningLevel") or ""
            now, newest = None, ""
            waiting: tuple[str, list[str], int] | None = None
            joined = "select m.id, m.time_created, m.data, p.data from message m join part p on p.message_id = m.id where m.session_id = ? order by m.time_created, m.id, p.time_created, p.id"
            for mid, at, head, body in [*db.execute(joined, (row[0],)), (None, 0, "{}", "{}")]:
                if mid != now:
                    if waiting:
                        _say(c, waiting[0], "\n".join(waiting[1]).strip(), waiting[2])
                    m = _object(head, c.id)
                    now, waiting, newest = mid, (m.get("role") or "", [], at), m.get("modelID") or newest
                p = _object(body, c.id)
                if p.get("type") == "text" and (p.get("text") or "").strip():
                    waiting[1].append(p["text"].strip())
            c.model, c.updated = c.model or newest, c.updated or c.started
            out.append(c)
    return out


READERS = {"opencode": opencode, "zcode": zcode}


def newest(found: list[Conversation]) -> int:
    """The watermark after reading: the latest update in epoch milliseconds."""
    return max((int((c.updated or c.started).timestamp() * 1000) for c in found if c.updated or c.started), default=0)


class SnapshotStore(DataSource):
    """``spark.read.format("session_store").option("since", ms).load(path)``; a path may be several, joined by commas."""

    @classmethod
    def name(cls) -> str:
        return "session_store"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return SnapshotReader(self.options)


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.since = int(options.get("since", 0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for c in READERS[classify(partition.value)](partition.value, self.since):
            row = c.row()
            said = [(m["seq"], m["role"], m["text"], m["created_at"]) for m in row.pop("messages")]
            yield (*row.values(), said)


def local_folder(uri: str) -> str:
    """The absolute folder of a file address on this machine, or nothing."""
    u = urlsplit(uri)
    path = unquote(u.path)
    return clean_path(path) if u.scheme == "file" and not u.netloc and path.startswith("/") else ""


def antigravity_folders(db_path: str) -> dict[str, str]:
    """Conversation to workspace; what cannot be read stays unknown."""
    out: dict[str, str] = {}
    with contextlib.suppress(sqlite3.Error, OSError), reading(db_path) as db:
        for conversation, uris in db.execute("select conversation_id, workspace_uris from conversation_summaries"):
            with contextlib.suppress(TypeError, ValueError):
                found = json.loads(uris)
                if folder := next(filter(None, (local_folder(u) for u in found if isinstance(u, str))), ""):
                    out[conversation] = folder
    return out


def cursor_slug(folder: str) -> str:
    return "-".join("".join(c if c.isalpha() or c.isdecimal() or c == "-" else "-" for c in part.lstrip(".")) for part in folder.strip("/").split("/"))


def cursor_folders(workspaces: list[str]) -> dict[str, str]:
    """Slug to folder from the contents of workspace files; slugs of several folders are left out."""
    found: dict[str, set[str]] = {}
    for text in workspaces:
        with contextlib.suppress(TypeError, ValueError, AttributeError):
            if folder := local_folder(json.loads(text).get("folder") or ""):
                found.setdefault(cursor_slug(folder), set()).add(folder)
    return {slug: next(iter(f)) for slug, f in found.items() if len(f) == 1}


def store_id(path: str) -> str:
    return re.sub(r"\W+", "_", str(PurePosixPath(path)))
