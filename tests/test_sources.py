import json
import sqlite3

import pytest
import zstandard

from logloom.sources import files, formats, snapshots
from logloom.sources.records import UnexpectedFormat


def lines(*records):
    return "".join(json.dumps(r) + "\n" for r in records).encode()


def said(c):
    return [(m[1], m[2]) for m in c.messages]


def test_classify():
    for path, kind in [("/h/.codex/sessions/a.jsonl", "codex"), ("/h/.claude/projects/p/a.jsonl", "claude"), ("/h/muse/sessions/1/session.jsonl", "muse"), ("/h/.cursor/projects/s/agent-transcripts/a.jsonl", "cursor"), ("/h/.cursor/plans/x.plan.md", "cursor_plan"), ("/h/opencode.db", "opencode"), ("/h/.zcode/cli/db/db.sqlite", "zcode"), ("/h/.dsh/sessions/a/b/session.v4.jsonl.zstd", "dsh"), ("/h/.gemini/antigravity/brain/u/.system_generated/logs/transcript_full.jsonl", "antigravity"), ("/h/notes.txt", "")]:
        assert formats.classify(path) == kind


def test_codex():
    c = formats.parse(
        "/h/.codex/a.jsonl",
        lines(
            {"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": "s1", "cwd": "/w/x/", "base_instructions": {"provenance": {"model": "m0"}}}},
            {"timestamp": "2026-01-01T00:00:01Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi [external_agent_tool_call: X] no [/external_agent_tool_call]"}]}},
            {"timestamp": "2026-01-01T00:00:01.5Z", "type": "event_msg", "payload": {"type": "item_completed", "item": {"type": "UserMessage", "content": [{"type": "Text", "text": "hi"}]}}},
            {"timestamp": "2026-01-01T00:00:02Z", "type": "response_item", "payload": {"type": "reasoning"}},
            {"timestamp": "2026-01-01T00:00:03Z", "type": "event_msg", "payload": {"type": "turn_aborted", "reason": "stop"}},
        ),
    )
    row = c.row()
    assert said(c) == [("user", "hi"), ("note", "turn aborted: stop")]
    assert (row["session_id"], row["project"], row["model"], row["effort"]) == ("s1", "/w/x", "m0", "Unknown")


def test_repeats_compare_with_the_last_kept():
    rows = [{"type": "user", "timestamp": f"2026-01-01T00:00:0{t}Z", "message": {"content": "same"}} for t in ("0", "0.8", "1.6")]
    c = formats.parse("/h/.claude/projects/p/a.jsonl", lines(*rows))
    assert len(c.messages) == 2


def test_claude_muse_cursor():
    c = formats.parse("/h/.claude/projects/p/a.jsonl", lines({"type": "assistant", "sessionId": "q", "cwd": "/c", "message": {"model": "big", "content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": "yes"}]}, "effort": "high"}, {"type": "summary", "content": "sum"}))
    assert said(c) == [("assistant", "yes"), ("system", "sum")] and (c.id, c.model, c.effort) == ("q", "big", "high")
    inner = json.dumps({"stream": {"id": "m1"}, "recorded_at": 1_700_000_000_000_000, "payload_type": "runtime.session", "payload": {"event": {"kind": "assistant_message_committed", "text": "ok"}}})
    c = formats.parse("/h/muse/sessions/1/session.jsonl", lines({"payload_type": "runtime.user_intent.accepted", "payload": {"refill_blocks": [{"kind": "text", "text": "do"}]}}, {"retained_frame": "f", "children": [{"record_json": inner}]}, {"retained_marker": 1}))
    assert said(c) == [("user", "do"), ("assistant", "ok")] and c.id == "m1"
    c = formats.parse("/h/.cursor/projects/slug/agent-transcripts/t.jsonl", lines({"role": "user", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool_use"}]}}, {"type": "turn_ended", "status": "error", "error": "x"}, {"type": "turn_ended", "status": "success"}))
    assert said(c) == [("user", "a"), ("note", "turn error: x")] and c.project == "cursor:slug"


def test_antigravity_and_dsh():
    path = "/h/.gemini/antigravity/brain/u1/.system_generated/logs/transcript_full.jsonl"
    c = formats.parse(path, lines({"step_index": 0, "type": "USER_INPUT", "content": "<USER_REQUEST>go</USER_REQUEST><ADDITIONAL_METADATA>", "model": "gem-high"}, {"step_index": 1, "type": "GENERIC", "content": "no"}, {"step_index": 2, "type": "PLANNER_RESPONSE", "content": "done"}), folders={"antigravity": {"u1": "/w"}})
    assert said(c) == [("user", "go"), ("assistant", "done")] and (c.id, c.project, c.model, c.effort) == ("antigravity:u1", "/w", "gem", "high")
    rows = [{"type": "session", "version": 4, "id": "d", "createdAt": 1000, "cwd": "/d"}, {"type": "user/message", "time": 2000, "data": {"source": {"kind": "user"}, "content": [{"type": "text", "text": "q"}]}}, {"type": "user/message", "data": {"source": {"kind": "host"}, "content": [{"type": "text", "text": "no"}]}}, {"type": "assistant/message", "time": 3000, "data": {"message": {"content": [{"type": "text", "text": "a"}]}}}]
    frames = [zstandard.compress(lines(r)) for r in rows]
    c = formats.parse("/h/.dsh/sessions/a/b/session.v4.jsonl.zstd", b"".join(frames))
    assert said(c) == [("user", "q"), ("assistant", "a")] and c.id == "dsh:d"
    torn = formats.parse("/h/.dsh/sessions/a/b/session.v4.jsonl.zstd", b"".join(frames[:3]) + frames[3][:-3])
    assert said(torn) == [("user", "q")]
    with pytest.raises(UnexpectedFormat):
        formats.parse("/h/.dsh/sessions/a/b/s.jsonl.zstd", zstandard.compress(lines({"type": "session", "version": 5, "id": "d"})))


def test_broken_files():
    good = lines({"type": "user", "message": {"content": "a"}})
    assert len(formats.parse("/h/.claude/projects/p/a.jsonl", good + b'{"type": "us').messages) == 1
    for bad in (b"{nope}\n", b'{"a": 1}\n', good + b'{"type": "us\n'):
        with pytest.raises(UnexpectedFormat):
            formats.parse("/h/.claude/projects/p/a.jsonl", bad)


def test_files_as_rows(spark, tmp_path):
    folder = tmp_path / ".claude/projects/p"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_bytes(lines({"type": "user", "sessionId": "s", "message": {"content": "hello"}}))
    (folder / "b.jsonl").write_bytes(b"{broken}\n")
    (tmp_path / "x.plan.md").write_text("# Plan")
    found = files.discover([str(tmp_path), str(tmp_path / "missing")])
    assert [k for _, k in found] == ["claude", "claude", "cursor_plan"]
    parsed = files.parse_files(spark, [p for p, _ in found]).cache()
    assert parsed.where("error is not null").count() == 1
    assert {(r.session_id, r.role, r.text) for r in files.messages(parsed).collect()} == {("s", "user", "hello"), ("x", "note", "# Plan")}


def test_grown_files(tmp_path):
    path = tmp_path / ".claude/projects/p/a.jsonl"
    path.parent.mkdir(parents=True)
    path.write_bytes(lines({"type": "user", "sessionId": "s", "message": {"content": "one"}}))
    before = files.checkpoint(str(path))
    known = formats.parse(str(path), path.read_bytes())
    known.messages.clear()
    assert not files.has_grown(str(path), before)
    with path.open("ab") as f:
        f.write(lines({"type": "assistant", "sessionId": "s", "message": {"content": "two"}}))
    assert files.has_grown(str(path), before)
    more = files.read_appended(str(path), before, known)
    assert [m[:3] for m in more.messages] == [(1, "assistant", "two")]


def test_snapshot_stores(spark, tmp_path):
    path = str(tmp_path / "opencode.db")
    db = sqlite3.connect(path)
    db.executescript("""create table project(id, worktree); create table session_v2(id, project_id, directory, time_created, time_updated, model);
        create table session_message(id, session_id, type, seq, time_created, data); insert into project values (1, '/w');
        insert into session_v2 values ('a', 1, '', 1000, 5000, '{"id": "m", "variant": "v"}'), ('b', 1, '/b', 2000, null, null);""")
    for i, (kind, body) in enumerate([("user", {"text": " hi "}), ("tool", {}), ("assistant", {"content": [{"type": "text", "text": "x"}, {"type": "reasoning"}, {"type": "text", "text": "y"}]})]):
        db.execute("insert into session_message values (?, 'a', ?, ?, 3000, ?)", (i, kind, i, json.dumps(body)))
    db.commit()
    found = snapshots.opencode(path)
    assert [(c.id, c.project, c.model) for c in found] == [("opencode:a", "/w", "m"), ("opencode:b", "/b", "")]
    assert said(found[0]) == [("user", "hi"), ("assistant", "x\ny")]
    assert [c.id for c in snapshots.opencode(path, 5000)] == ["opencode:a"] and snapshots.newest(found) == 5000
    spark.dataSource.register(snapshots.SnapshotStore)
    rows = spark.read.format("session_store").option("since", 5000).load(path).collect()
    assert len(rows) == 1 and rows[0].messages[1].text == "x\ny"
    (tmp_path / ".zcode/cli/db").mkdir(parents=True)
    zpath = str(tmp_path / ".zcode/cli/db/db.sqlite")
    db = sqlite3.connect(zpath)
    db.executescript("""create table session(id, parent_id, directory, time_created); create table message(id, session_id, time_created, data); create table part(id, message_id, session_id, time_created, data);
        insert into session values ('sess_z', null, '/z', 1000); insert into message values ('m1', 'sess_z', 1, '{"role": "user"}'), ('m2', 'sess_z', 2, '{"role": "assistant", "modelID": "zz"}'), ('m3', 'sess_z', 3, '{"role": "user"}');
        insert into part values (1, 'm1', 'sess_z', 1, '{"type": "text", "text": "q1"}'), (2, 'm1', 'sess_z', 2, '{"type": "text", "text": "q2"}'), (3, 'm2', 'sess_z', 1, '{"type": "text", "text": "a"}'), (4, 'm3', 'sess_z', 1, '{"type": "file"}');""")
    db.commit()
    (z,) = snapshots.zcode(zpath)
    assert said(z) == [("user", "q1\nq2"), ("assistant", "a")] and (z.id, z.model) == ("zcode:z", "zz")


def test_workspace_maps():
    assert snapshots.cursor_slug("/home/a.b/.x/my proj") == "home-a-b-x-my-proj"
    texts = [json.dumps({"folder": f}) for f in ("file:///home/a/x", "file:///home/b_c", "file:///home/b-c", "vscode-remote://x/y")] + ["junk"]
    assert snapshots.cursor_folders(texts) == {"home-a-x": "/home/a/x"}
