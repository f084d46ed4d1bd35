"""Incremental ingestion of files that grow: cycles over folders, by hand, on a timer, or as a stream's batches."""

from __future__ import annotations

import gzip
import json
import os
import shutil
import time
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..schemas import CHECKPOINTS
from ..sources import files, formats, git, snapshots
from ..sources.records import Conversation, UnexpectedFormat

PARSER_VERSION = 1


def rows_of(spark: SparkSession, found: list[tuple[Conversation, str]]) -> DataFrame:
    """Parsed conversations as the readers give them."""
    data = []
    for c, kind in found:
        row = c.row()
        made, written = files.file_times(c.path)
        row = files.with_file_times(row, kind, made, written)
        said = [tuple(m.values()) for m in row.pop("messages")]
        data.append((*row.values(), said, kind, None))
    return spark.createDataFrame(data, files.PARSED)


class Daemon:
    """A cycle looks at every session file: unchanged ones are passed over, grown ones are read from where they ended,
    others whole. A file that cannot be read is told of and the cycle goes on."""

    def __init__(self, engine: Engine, roots: list[str], log: str | None = None, min_df: int = 2):
        self.engine, self.roots, self.log, self.min_df = engine, roots, log, min_df

    def folders(self, found: list[tuple[str, str]]) -> dict[str, dict[str, str]]:
        """Workspaces that hosts keep outside their logs."""
        out: dict[str, dict[str, str]] = {"cursor": {}, "antigravity": {}}
        homes = {p.split("/.cursor/projects/")[0] for p, k in found if k == "cursor" and "/.cursor/projects/" in p}
        for home in homes:
            texts = [p.read_text(errors="replace") for p in Path(home, ".config/Cursor/User/workspaceStorage").glob("*/workspace.json")]
            out["cursor"] |= snapshots.cursor_folders(texts)
        for base in {p.split("/brain/")[0] for p, k in found if k == "antigravity"}:
            out["antigravity"] |= snapshots.antigravity_folders(f"{base}/conversation_summaries.db")
        return out

    def cycle(self) -> dict:
        """One pass: files and stores in, copies out if something changed, new messages into the graph."""
        began, errors = time.time(), []
        found = files.discover(self.roots, lambda p, e: errors.append({"path": p, "error": str(e)}))
        known = {r["path"]: r.asDict() for r in self.engine.table("file_checkpoints").collect()}
        folders = self.folders(found)
        whole, grown, points, meta = [], [], {}, {}
        for path, kind in found:
            try:
                if kind in snapshots.READERS:
                    key = f"snapshot_mark:{path}"
                    since = int(next((r[0] for r in self.engine.table("meta").where(F.col("key") == key).select("value").collect()), 0))
                    before = known.get(path) or {}
                    if before.get("parser_version") != PARSER_VERSION:
                        since = 0  # another parser reads everything again
                    elif files.store_state(path) == (before["size"], before["mtime_ns"]):
                        continue
                    got = snapshots.READERS[kind](path, since)
                    whole += [(c, kind) for c in got]
                    meta[key] = str(max(since, snapshots.newest(got)))
                    size, at = files.store_state(path)
                    points[path] = {"path": path, "size": size, "mtime_ns": at, "tail_hash": "", "ends_line": False, "session_id": "", "project": ""}
                    continue
                now, before = files.checkpoint(path), known.get(path)
                if before and (before["size"], before["mtime_ns"], before["parser_version"]) == (now["size"], now["mtime_ns"], PARSER_VERSION):
                    continue
                c = self._grown(path, kind, before) if before and before["parser_version"] == PARSER_VERSION else None
                if c is not None:
                    grown.append((c, kind))
                else:
                    with open(path, "rb") as f:
                        c = formats.parse(path, f.read(), kind, folders)
                    whole.append((c, kind))
                after = files.checkpoint(path)
                if (after["size"], after["mtime_ns"]) == (now["size"], now["mtime_ns"]):  # else it grew meanwhile and is read again
                    points[path] = now | {"session_id": c.row()["session_id"], "project": c.row()["project"]}
            except (UnexpectedFormat, OSError) as e:
                errors.append({"path": path, "error": str(e)})
        actions = self._take(whole, grown)
        changed = sum(n for action, n in actions.items() if action != "same")
        self._identify({c.row()["project"] for c, _ in whole})
        self.engine.prepare_copies()
        suppressed = self.engine.suppress_copies() if changed else 0
        index = self.engine.index_new(self.min_df)
        if points:
            old = self.engine.table("file_checkpoints").where(~F.col("path").isin(*points))
            new = self.engine.spark.createDataFrame([tuple(p[f.name] if f.name != "parser_version" else PARSER_VERSION for f in CHECKPOINTS) for p in points.values()], CHECKPOINTS)
            self.engine.store.commit({"file_checkpoints": old.unionByName(new)})
        if meta:
            self.engine.set_meta(**meta)
        status = {"at": datetime.now(UTC).isoformat(), "seconds": round(time.time() - began, 3), "files": len(found), "changed": changed, "suppressed": suppressed, "blocked": self.engine.table("no_ingest").count(), "indexed": index, "errors": errors}
        self.engine.store.sweep()
        self._tell(status)
        return status

    def _identify(self, names: set[str]) -> None:
        """Remembers the repositories of projects that are folders here."""
        known = {r["project"] for r in self.engine.table("project_identities").select("project").collect()}
        for name in sorted(n for n in names if n.startswith("/") and n not in known):
            if found := git.identity(name):
                self.engine.save_identity(name, **found)

    def _grown(self, path: str, kind: str, before: dict) -> Conversation | None:
        """What a file has gained, unless it must be read whole: a copy, whose messages are not stored, is."""
        if kind not in formats.APPENDABLE or not files.has_grown(path, before):
            return None
        engine = self.engine
        if not engine.table("session_copies").where((F.col("session_id") == before["session_id"]) & (F.col("duplicate_of") != "")).isEmpty():
            return None
        last = engine.table("messages").where(F.col("session_id") == before["session_id"]).orderBy(F.desc("seq")).limit(1).collect()
        head = engine.table("sessions").where(F.col("session_id") == before["session_id"]).collect()
        if not last or not head:
            return None
        utc = lambda t: t.astimezone(UTC) if t else None
        h, m = head[0], last[0]
        c = Conversation(h["source"], path, h["session_id"], h["project"], h["model"], h["effort"], utc(h["started_at"]), last=(m["seq"], m["role"], m["text"], utc(m["created_at"])))
        return files.read_appended(path, before, c)

    def _take(self, whole: list, grown: list) -> dict[str, int]:
        """Whole conversations as they are, grown ones after what is stored of them."""
        spark, out = self.engine.spark, {}
        rows = rows_of(spark, whole) if whole else None
        added = [(c, k) for c, k in grown if c.messages]
        if added:
            stored = self.engine.table("messages").where(F.col("session_id").isin(*[c.id for c, _ in added]))
            old = stored.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text", "created_at"))).alias("old"))
            more = rows_of(spark, added).join(old, "session_id", "left").withColumn("messages", F.concat(F.coalesce("old", F.array().cast("array<struct<seq:int,role:string,text:string,created_at:timestamp>>")), "messages")).drop("old")
            rows = more if rows is None else rows.unionByName(more)
        if rows is not None:
            out = self.engine.ingest(rows, lambda paths: files.parse_files(spark, paths))
        return out

    def _tell(self, status: dict) -> None:
        """The last status, replaced in one step, and a line for each cycle in a file of its month."""
        if self.log:
            folder = Path(self.log)
            folder.mkdir(parents=True, exist_ok=True)
            fresh = folder / ".status.json.new"
            fresh.write_text(json.dumps(status))
            os.replace(fresh, folder / "status.json")
            month = status["at"][:7]
            with (folder / f"sync-{month}.jsonl").open("a") as f:
                f.write(json.dumps(status) + "\n")
            self.rotate(folder, month)

    @staticmethod
    def rotate(folder: Path, month: str, keep: int = 3) -> None:
        """Packs the logs of months that are over, and deletes those more than ``keep`` months old."""
        for old in folder.glob("sync-*.jsonl"):
            if old.stem.removeprefix("sync-") < month:
                with old.open("rb") as source, gzip.open(f"{old}.gz", "wb") as target:
                    shutil.copyfileobj(source, target)
                old.unlink()
        year, number = map(int, month.split("-"))
        first = year * 12 + number - 1 - keep
        for packed in folder.glob("sync-*.jsonl.gz"):
            y, n = map(int, packed.name[5:12].split("-"))
            if y * 12 + n - 1 < first:
                packed.unlink()

    def run(self, every: float = 300, stop: Callable[[], bool] = lambda: False) -> None:
        while not stop():
            self.cycle()
            if not stop():
                time.sleep(every)

    def stream(self, every: str = "5 minutes", checkpoint: str | None = None) -> StreamingQuery:
        """The cycles as a structured stream: a clock drives them, and a cycle that fails stops the query."""
        ticks = self.engine.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        writer = ticks.writeStream.foreachBatch(lambda df, i: self.cycle()).trigger(processingTime=every)
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
