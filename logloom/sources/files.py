"""Session files as DataFrames: found, told apart, and parsed a file at a time."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats
from .records import Conversation, UnexpectedFormat
from .snapshots import ROW

PARSED = f"{ROW}, kind string, error string"
TAIL = 4096


def discover(roots: list[str], report: Callable[[str, Exception], None] | None = None) -> list[tuple[str, str]]:
    """(path, kind) of all session files below the roots; roots that are missing are passed over, others' errors told."""
    out = []
    for root in roots:
        if os.path.isfile(root):
            out.append((root, formats.classify(root)))
            continue
        failed = lambda e: None if isinstance(e, FileNotFoundError) or report is None else report(root, e)
        for folder, _, names in os.walk(root, onerror=failed):
            out += [(p, formats.classify(p)) for p in (os.path.join(folder, n) for n in names)]
    return sorted({(p, kind) for p, kind in out if kind})


def kind_column(path: str = "path"):  # noqa: ANN201
    """The format of a path, as a column."""
    out = F.lit("")
    for kind, pattern in reversed(formats.RULES):
        out = F.when(F.col(path).rlike(pattern), kind).otherwise(out)
    return out


def file_times(path: str) -> tuple[datetime | None, datetime | None]:
    """When a file was made (its birth where the system tells it, else its change of state) and last written."""
    try:
        s = os.stat(path)
    except OSError:
        return None, None
    made = getattr(s, "st_birthtime", None) or s.st_ctime
    return datetime.fromtimestamp(made, UTC), datetime.fromtimestamp(s.st_mtime, UTC)


def with_file_times(row: dict, kind: str, made: datetime | None, written: datetime | None) -> dict:
    """Formats without dates of their own take those of the file."""
    if kind in ("cursor", "cursor_plan"):
        row["started_at"] = row["started_at"] or made
        row["updated_at"] = written or row["updated_at"]
    return row


def parse_files(spark: SparkSession, paths: list[str], folders: dict | None = None) -> DataFrame:
    """A row per file: the session, its messages in order, its kind, and an error for a file that cannot be read.

    Files are read whole, one task for some of them, as order within a file matters.
    """
    local = [p for p in paths if "://" not in p]
    raw = spark.read.format("binaryFile").load([Path(p).resolve().as_uri() if p in local else p for p in paths])
    names = {Path(p).resolve().as_uri().replace("file:///", "file:/"): p for p in local}
    return parse_contents(raw, folders, names)


def parse_contents(raw: DataFrame, folders: dict | None = None, names: dict | None = None) -> DataFrame:
    """The same from rows (path, modificationTime, content); ``names`` are other names of paths."""
    names = names or {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, written, content in zip(frame["path"], frame["modificationTime"], frame["content"], strict=True):
                path = names.get(path.replace("file:///", "file:/"), path)
                kind = formats.classify(path)
                try:
                    row = formats.parse(path, bytes(content), kind, folders).row() | {"error": None}
                except UnexpectedFormat as e:
                    row = Conversation(kind, path).row() | {"error": str(e)}
                made, _ = file_times(path)
                at = written.to_pydatetime().replace(tzinfo=UTC) if written is not None and not pd.isna(written) else None
                out.append(with_file_times(row, kind, made or at, at) | {"kind": kind})
            yield pd.DataFrame(out, columns=["session_id", "source", "project", "started_at", "path", "model", "effort", "updated_at", "messages", "kind", "error"])

    return raw.select("path", "modificationTime", "content").mapInPandas(run, PARSED)


def sessions(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is null").select("session_id", "source", "project", "started_at", "path", "model", "effort", "updated_at")


def messages(parsed: DataFrame) -> DataFrame:
    rows = parsed.where("error is null").select("session_id", "source", "project", F.explode("messages").alias("m"))
    return rows.select("session_id", "m.seq", "source", "project", "m.role", "m.text", "m.created_at")


def checkpoint(path: str) -> dict:
    """What tells whether a file has changed, and whether it has only grown."""
    s = os.stat(path)
    with open(path, "rb") as f:
        f.seek(max(0, s.st_size - TAIL))
        tail = f.read(TAIL)
    return {"path": path, "size": s.st_size, "mtime_ns": s.st_mtime_ns, "tail_hash": hashlib.sha256(tail).hexdigest(), "ends_line": tail.endswith(b"\n")}


def store_state(path: str) -> tuple[int, int]:
    """Size and newest change of a SQLite file and its log together."""
    found = [os.stat(p) for p in (path, f"{path}-wal") if os.path.exists(p)]
    return sum(s.st_size for s in found), max((s.st_mtime_ns for s in found), default=0)


def has_grown(path: str, before: dict) -> bool:
    """Whether a file is what it was, with whole lines after it."""
    if not before["ends_line"] or os.stat(path).st_size <= before["size"]:
        return False
    with open(path, "rb") as f:
        f.seek(max(0, before["size"] - TAIL))
        tail = f.read(min(TAIL, before["size"]))
    return hashlib.sha256(tail).hexdigest() == before["tail_hash"]


def read_appended(path: str, before: dict, known: Conversation) -> Conversation | None:
    """What came after a known conversation's last message; nothing if the new records belong to another session or
    project, when the whole file must be read."""
    with open(path, "rb") as f:
        f.seek(before["size"])
        data = f.read()
    was = known.id, known.project
    c = formats.parse(path, data, before=known)
    return c if (c.id, c.project) == was else None
