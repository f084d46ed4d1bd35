import json

import pytest

from logloom.operators import copies, graph, sessions
from logloom.operators.filters import ProjectFilter
from logloom.operators.projects import Resolver
from logloom.plans.engine import Engine
from logloom.plans.store import Conflict, MissingStore, Store
from logloom.sources import files
from logloom.streaming.daemon import Daemon


def parsed(spark, *found):
    """(id, source, project, [(role, text)])"""
    rows = [(i, s, p, None, f"/{i}", "m", "e", None, [(k, r, t, None) for k, (r, t) in enumerate(said)], s, None) for i, s, p, said in found]
    return spark.createDataFrame(rows, files.PARSED)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"))


def test_missing_store(spark, tmp_path):
    with pytest.raises(MissingStore):
        Store(spark, str(tmp_path / "none"), create=False)


def test_readers_keep_what_they_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = lambda *v: spark.createDataFrame([(x, "1") for x in v], "key string, value string")
    store.commit({"meta": rows("a", "b")})
    before = store.read("meta")
    store.commit({"meta": rows("c")})
    during = store.read("meta")
    store.repack()
    assert sorted(r.key for r in before.collect()) == ["a", "b"] and [r.key for r in during.collect()] == ["c"]
    assert store.vacuum() == 0 and before.count() == 2
    assert store.vacuum(keep_seconds=-1) == 2 and [r.key for r in store.read("meta").collect()] == ["c"]
    store.commit({}, {"meta": rows("d")})
    assert sorted(r.key for r in store.read("meta").collect()) == ["c", "d"]


def test_two_writers(spark, tmp_path):
    """Of two commits from one state one is refused; an engine's job is then done again."""
    a, b = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    rows = lambda v: spark.createDataFrame([(v, "1")], "key string, value string")
    with pytest.raises(Conflict), a.job():
        b.commit({}, {"meta": rows("b")})
        a.commit({}, {"meta": rows("a")})
    assert [r.key for r in a.read("meta").collect()] == ["b"] and a.pinned is None
    one, two = (Engine(spark, str(tmp_path / "engine")) for _ in range(2))
    plain, first = one._meta, []

    def meddled(**values):
        made = plain(**values)
        if not first:
            first.append(two.set_meta(other="2"))
        return made

    one._meta = meddled
    one.set_meta(mine="1")
    assert {r.key: r.value for r in two.table("meta").collect()} == {"mine": "1", "other": "2"}


def test_search_and_word_forms(spark, engine):
    engine.ingest(parsed(spark, ("a", "x", "/p", [("user", "the enemies disengaged at dawn"), ("assistant", "sailing boats")]), ("b", "x", "/q", [("user", "enemy ships"), ("system", "enemy context")])))
    hits = engine.search("enemy disengage").collect()
    assert [(h.session_id, h.seq) for h in hits] == [("a", 0), ("b", 0)] and "disengaged" in hits[0].snippet
    assert engine.search("nothing like whatsoever").count() == 0
    assert [h.session_id for h in engine.search("enemy", project="/q").collect()] == ["b"]
    for bad in ({"limit": 0}, {"limit": -1}):
        with pytest.raises(ValueError):
            engine.search("enemy", **bad)
    with pytest.raises(ValueError):
        engine.search("!")


def test_reconciliation(spark, engine):
    first = ("a", "x", "/p", [("user", "alpha beta"), ("assistant", "gamma")])
    assert engine.ingest(parsed(spark, first)) == {"new": 1}
    assert engine.ingest(parsed(spark, first)) == {"same": 1}
    assert engine.ingest(parsed(spark, ("a", "x", "/p", [*first[3], ("user", "delta")]))) == {"append": 1}
    assert engine.ingest(parsed(spark, ("a", "x", "/p", [("user", "changed"), ("assistant", "gamma")]))) == {"rewrite": 1}
    assert [(r.seq, r.text) for r in engine.table("messages").orderBy("seq").collect()] == [(0, "changed"), (1, "gamma")]
    assert {r.term for r in engine.table("postings").collect()} == {"chang", "gamma"}


TALK = [(f"s{i}", "x", "/p", [("user", f"turbine gearbox vibration {w}"), ("assistant", f"gearbox oil {w} lubricant")]) for i, w in enumerate(["one1", "two2", "three3", "four4"])]
OTHER = [(f"o{i}", "x", "/p", [("user", f"garden {w}")]) for i, w in enumerate(["roses", "tulips", "lawn", "hedge", "fence", "pond", "gate", "shed", "path", "tree", "bench", "stone", "brick", "grass", "leaf", "twig", "bulb", "root"])]


def test_graph_incremental_full_and_undo(spark, engine, tmp_path):
    engine.ingest(parsed(spark, *TALK, *OTHER))
    assert engine.index_new(2)["messages"] == 26
    weights = lambda e: {(r.term_a, r.term_b): r.weight for r in e.table("topic_edges").collect()}
    once = weights(engine)
    assert once and all(once[b, a] == w for (a, b), w in once.items())
    assert engine.index_new(2) == {"messages": 0, "pairs": 0}
    engine.index_full(2)
    assert weights(engine) == once
    engine.purge("s3")
    less = weights(engine)
    assert set(less) <= set(once) and sum(less.values()) < sum(once.values())
    again = Engine(spark, str(tmp_path / "second"))
    again.ingest(parsed(spark, *TALK[:3], *OTHER))
    again.index_new(2)
    assert {(r.project, r.term): r.msgs for r in engine.table("term_df").collect()} == {(r.project, r.term): r.msgs for r in again.table("term_df").collect()}
    found = engine.related("vibrations")
    assert {"turbine"} <= {r["term"] for r in found}


EDGES = "project string, term_a string, term_b string, kind string, from_term string, to_term string, weight long, evidence string"


def test_related_depths(spark, engine):
    rows = [("p1", "x", "y", "", "", "", 5, ""), ("p1", "x", "z", "", "", "", 2, ""), ("p1", "w", "y", "", "", "", 3, ""), ("p2", "q", "x", "", "", "", 9, "")]
    engine.replace_edges(spark.createDataFrame(rows, EDGES))
    edges, where = engine.table("topic_edges"), ProjectFilter(values=("P1",))
    told = lambda d: [(r.term, r.weight, r.via) for r in graph.related(edges, "x", d, 10, where).collect()]
    assert told(1) == [("y", 5, ""), ("z", 2, "")]
    assert told(2) == [("w", 8, "y"), ("y", 5, ""), ("z", 2, "")]
    for bad in ((0, 1), (10, 3)):
        with pytest.raises(ValueError):
            graph.related(edges, "x", bad[1], bad[0])


def test_typed_relations_rank_first(spark, engine):
    rows = [("p", "a", "x", "", "", "", 9, ""), ("p", "b", "x", "owns", "x", "b", 2, ""), ("p", "c", "x", "owns", "x", "c", 1, "")]
    engine.replace_edges(spark.createDataFrame(rows, EDGES))
    assert [r["term"] for r in engine.related("x")] == ["b", "a", "c"]


def test_recall(spark, engine):
    talk = ("abcd1234-x", "x", "/p", [("user", "<env>"), ("user", "fix the turbine"), ("assistant", "turbine fixed"), ("user", "fix the turbine"), ("note", "turn aborted: stop")])
    engine.ingest(parsed(spark, talk, ("other", "x", "/p", [("user", "turbine again")])))
    got = engine.recall("turbine", limit=5, per_session=2).sessions
    assert {s["session_id"] for s in got} == {"abcd1234-x", "other"}
    mine = next(s for s in got if s["session_id"] == "abcd1234-x")
    assert mine["title"] == "fix the turbine" and len(mine["hits"]) == 2 and [e["seq"] for e in mine["ending"]] == [2, 3, 4]
    named = engine.recall("what of abcd1234 turbine", limit=1).sessions
    assert named[0]["session_id"] == "abcd1234-x" and named[0]["named"]
    assert engine.resolve_session("abcd") == "abcd1234-x"
    with pytest.raises(LookupError):
        engine.resolve_session("zzz")
    assert [r.seq for r in engine.window("abcd1234-x", 0, 2).collect()] == [1, 2]
    assert [r.seq for r in engine.window("abcd1234-x", 0, 2, keep=0).collect()] == [0, 1, 2]


def test_graph_fills_open_places(spark, engine):
    engine.ingest(parsed(spark, *TALK, *OTHER, ("far", "x", "/p", [("user", "turbine shelf")])))
    engine.index_full(2)
    got = engine.recall("vibration", limit=20, per_session=1)
    assert got.related and any(s["via_graph"] for s in got.sessions)
    assert not any(s["via_graph"] for s in engine.recall("vibration", limit=1, per_session=1).sessions)


def test_copies(spark, engine):
    body = [("user", "q" * 200), ("assistant", "a" * 200), ("user", "r" * 200)]
    engine.ingest(parsed(spark, ("long", "x", "/p", [*body, ("assistant", "more")]), ("short", "y", "/p", body), ("same", "x", "/p", body), ("else", "y", "/other", body)))
    n = engine.suppress_copies()
    found = {(r.session_id, r.duplicate_of) for r in engine.table("session_copies").where("duplicate_of <> ''").collect()}
    assert found <= {("short", "long"), ("short", "same"), ("same", "short")} and n == len(found) > 0
    assert engine.suppress_copies() == 0
    pairs = {(r.copy_id, r.owner_id) for r in copies.covered_pairs(engine.table("session_copies").join(engine.table("sessions").select("session_id", "source", "project"), "session_id")).collect()}
    assert ("short", "long") in pairs and all("else" not in p for p in pairs)


def test_privacy(spark, engine):
    engine.ingest(parsed(spark, ("a", "x", "/p", [("user", "hello world")])))
    engine.ingest(parsed(spark, ("a", "x", "/p", [("user", "Private: hello world")]), ("b", "x", "/p", [("user", "privacy of things")])))
    assert {r.session_id for r in engine.table("messages").collect()} == {"b"} and {r.session_id for r in engine.table("no_ingest").collect()} == {"a"}
    engine.ingest(parsed(spark, ("a", "x", "/p", [("user", "harmless")])))
    assert engine.table("sessions").count() == 1


def test_rename_and_aliases(spark, engine):
    engine.ingest(parsed(spark, *TALK, *OTHER, ("z", "x", "/taken", [("user", "word")])))
    engine.index_full(2)
    with pytest.raises(ValueError):
        engine.rename_project("/p", "/TAKEN")
    assert engine.rename_project("p", "/new")["sessions"] == 22
    assert {r.project for r in engine.table("topic_edges").collect()} == {"/new"}
    assert all(r.src_id.startswith("/new\x1f") for r in engine.table("topic_edges").collect())
    assert engine.resolve_project("/p").reason == "alias"
    engine.ingest(parsed(spark, ("late", "x", "/p", [("user", "late")])))
    assert engine.table("sessions").where("session_id = 'late'").first().project == "/new"


def test_resolver():
    r = Resolver({"/h/app": 3, "/w/App2": 2, "/h/wt/app": 1, "tool": 1}, {"/old/thing": "tool"}, {"/h/app": {"remote_url": "github.com/me/app"}, "/w/App2": {"remote_url": "github.com/me/app"}, "tool": {"repo_root": "/t"}})
    assert r.resolve("/H/APP").matched == ["/h/app", "/w/App2"] and r.resolve("/H/APP").reason == "identity"
    assert r.resolve("thing").matched == ["tool"] and r.resolve("thing").reason == "alias"
    assert r.resolve("app").ambiguous and r.resolve("app2").reason == "identity"
    assert r.resolve("/t").reason == "identity" and r.resolve("oo").reason == "substring"
    none = r.resolve("tooll")
    assert none.reason == "none" and none.filter.no_match and none.candidates[0][0] == "tool"
    assert list(r.shared()) == ["remote:github.com/me/app"]


def test_repack(spark, engine, tmp_path):
    engine.ingest(parsed(spark, *TALK))
    before = engine.table("messages").count()
    assert engine.repack()["messages"] == before == engine.table("messages").count()
    engine.repack(str(tmp_path / "elsewhere"))
    assert Engine(spark, str(tmp_path / "elsewhere"), create=False).search("turbine").count() > 0


def test_daemon(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    path = tmp_path / "home/.claude/projects/p/a.jsonl"
    path.parent.mkdir(parents=True)
    line = lambda who, text: json.dumps({"type": who, "sessionId": "s", "cwd": "/w", "message": {"content": text}}) + "\n"
    path.write_text(line("user", "turbine one"))
    (path.parent / "bad.jsonl").write_text("{nope}\n")
    daemon = Daemon(engine, [str(tmp_path / "home")], str(tmp_path / "log"))
    first = daemon.cycle()
    assert first["changed"] == 1 and len(first["errors"]) == 1
    assert daemon.cycle()["changed"] == 0
    with path.open("a") as f:
        f.write(line("assistant", "gearbox two"))
    assert daemon.cycle()["changed"] == 1
    assert [(r.seq, r.text) for r in engine.table("messages").orderBy("seq").collect()] == [(0, "turbine one"), (1, "gearbox two")]
    path.write_text(line("user", "another start"))
    daemon.cycle()
    assert [r.text for r in engine.table("messages").collect()] == ["another start"]
    assert json.loads((tmp_path / "log/status.json").read_text())["files"] == 2


def test_named_sessions():
    assert sessions.references("see abcdef12 and plainwords or ABCDEF12") == ["abcdef12"]


def test_copies_come_back_before_their_owner_is_rewritten(spark, engine):
    body = [("user", "q" * 200), ("assistant", "a" * 200), ("user", "r" * 200)]
    copy = ("short", "y", "/p", body)
    engine.ingest(parsed(spark, ("long", "x", "/p", [*body, ("assistant", "more")]), copy))
    assert engine.suppress_copies() == 1
    assert engine.resolve_session("short") == "long"
    engine.ingest(parsed(spark, ("long", "x", "/p", [("user", "all new")])), load=lambda paths: parsed(spark, copy))
    assert engine.table("messages").where("session_id = 'short'").count() == 3 and engine.resolve_session("short") == "short"


def test_point_reads_and_maintenance(spark, engine, tmp_path):
    engine.ingest(parsed(spark, *TALK[:2]))
    assert engine.session("s0")["project"] == "/p" and engine.session("none") is None
    assert engine.last_message("s0")["seq"] == 1 and engine.counts() == {"sessions": 2, "messages": 4}
    assert engine.ensure_schemas() == ["postings", "graph"] and engine.ensure_schemas() == []
    engine.backfill_sessions()
    assert [r.seq for r in engine.show("s0", around=1, context=1).collect()] == [0, 1]
    assert engine.relocate(str(tmp_path / "moved"), "turbine")["messages"] == 4


def test_registered_functions(spark):
    from logloom.functions.register import register

    register(spark)
    row = spark.sql("select porter_stem('enemies') a, clean_path('/x//y/') b, snippet('a turbine hums', array('turbin'), 40) c, size(embed_text('turbine hums')) d").first()
    assert tuple(row) == ("enemi", "/x/y", "a turbine hums", 384)
    assert [r.term for r in spark.sql("select * from explode_terms('the turbine, the gearbox and the turbine')").collect()] == ["turbine", "gearbox"]


def test_log_rotation(tmp_path):
    for month in ("2026-01", "2026-06", "2026-09", "2026-10"):
        (tmp_path / f"sync-{month}.jsonl").write_text("{}\n")
    Daemon.rotate(tmp_path, "2026-10")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["sync-2026-09.jsonl.gz", "sync-2026-10.jsonl"]


def test_git_identity(tmp_path):
    import subprocess

    from logloom.sources import git

    assert git.identity(str(tmp_path / "none")) is None
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "config", "remote.origin.url", "git@github.com:me/repo.git"], check=True)
    assert git.identity(str(tmp_path))["remote_url"] == "github.com/me/repo"


def test_daemon_as_a_stream(spark, tmp_path):
    import time

    engine = Engine(spark, str(tmp_path / "store"))
    path = tmp_path / "home/.claude/projects/p/a.jsonl"
    path.parent.mkdir(parents=True)
    path.write_text(json.dumps({"type": "user", "sessionId": "s", "cwd": "/w", "message": {"content": "turbine one"}}) + "\n")
    running = Daemon(engine, [str(tmp_path / "home")], str(tmp_path / "log")).stream("1 second", str(tmp_path / "points"))
    try:
        end = time.time() + 90
        while not (tmp_path / "log/status.json").exists() and running.isActive and time.time() < end:
            time.sleep(0.5)
    finally:
        running.stop()
    assert running.exception() is None and engine.counts() == {"sessions": 1, "messages": 1}
