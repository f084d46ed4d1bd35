"""The engine: a store of conversations, and everything that can be asked of it or done to it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import porter, text, vectors
from ..functions.names import clean_path
from ..functions.snippets import snippet_column
from ..operators import copies, graph, postings, projects, ranking, reconcile, sessions
from ..operators.filters import EVERYTHING, ProjectFilter
from ..session import ship
from ..sources import files
from .store import Conflict, Store

#: Versions of the derived tables' contents.
TERMS_SCHEMA, EDGES_SCHEMA = "1", "6"


def writes(method: Callable) -> Callable:
    """A job of the store, done again from the new state if another writer came first."""

    @wraps(method)
    def run(self: Engine, *args, **more):  # noqa: ANN002, ANN003, ANN202
        for left in (2, 1, 0):
            try:
                with self.store.job():
                    return method(self, *args, **more)
            except Conflict:
                if not left or self.store.pinned is not None:  # the outermost job is done again
                    raise
        return None

    return run


@dataclass
class Recall:
    """Sessions in order: id, hits, and whether the query names them or only the graph led there."""

    sessions: list[dict] = field(default_factory=list)
    related: list[dict] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, root: str, stemmer: str = "porter", create: bool = True):
        ship(spark)
        self.spark, self.stemmer = spark, stemmer
        self.store = Store(spark, root, create)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    # Writes.

    @writes
    def ingest(self, parsed: DataFrame, load: Callable[[list[str]], DataFrame] | None = None) -> dict[str, int]:
        """Takes parsed sessions in: private ones are purged and remembered, names follow aliases, and each session is
        new, same, appended to, or rewritten. Returns how many sessions are which.

        Copies of a session that is about to be rewritten come back first: ``load`` parses files by their paths. If it
        fails, nothing is written. Which session is which stays a table, so a batch may be of any size.
        """
        good = parsed.where("error is null") if "error" in parsed.columns else parsed
        good = self.store.scratch(projects.apply_aliases(good, self.aliases()))
        heads = good.drop("messages", "kind", "error")
        rows = good.select("session_id", "source", "project", F.explode("messages").alias("m")).select("session_id", "m.seq", "source", "project", "m.role", "m.text", "m.created_at")
        known = self.table("no_ingest").select("session_id")
        tagged = self.store.scratch(copies.without(copies.exclusion_tags(rows), known).join(heads.select("session_id", "path"), "session_id").select("session_id", "path", "tag", F.current_timestamp().alias("marked_at")))
        if not tagged.isEmpty():
            self.store.commit({}, {"no_ingest": tagged})
            self.purge(tagged.select("session_id"))
        blocked = self.table("no_ingest").select("session_id")
        heads, rows = copies.without(heads, blocked), copies.without(rows, blocked)
        stored, actions = self._compare(rows)
        again = actions.where("action = 'rewrite'").select("session_id")
        back = self._copies_of(again) if load else None
        if back is not None and not back.isEmpty():
            paths = [r[0] for r in back.select("path").distinct().collect()]  # of a few copies whose owners changed
            restored = load(paths).join(back.select("session_id"), "session_id", "left_semi")
            free = self.table("session_copies").join(back.select("session_id", F.lit(True).alias("free")), "session_id", "left")
            self.store.commit({"session_copies": free.withColumn("duplicate_of", F.when(F.col("free"), "").otherwise(F.col("duplicate_of"))).drop("free")})
            self.ingest(restored)
            stored, actions = self._compare(rows)
            again = actions.where("action = 'rewrite'").select("session_id")
        counts = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
        changed = actions.where("action <> 'same'").select("session_id")
        if set(counts) - {"same"}:
            fresh = reconcile.rows_to_add(stored, rows, actions).withColumn("embedding", vectors.embed_words(text.content_words(F.col("text"))))
            more = {"messages": fresh, "postings": postings.build_postings(fresh, self.stemmer)}
            out = {}
            if counts.get("rewrite"):  # only then are the large tables written anew
                out = self._graph_without(again)
                for name in list(more):
                    out[name] = copies.without(self.table(name), again).select(*more[name].columns).unionByName(more.pop(name))
            at = heads.join(changed, "session_id", "left_semi").select("session_id", F.col("updated_at").alias("at"))
            out["sessions"] = reconcile.set_updated(reconcile.upsert_sessions(self.table("sessions"), heads), at)
            whole = copies.without(stored.join(changed, "session_id", "left_semi"), again).select("session_id", "seq", "role", "text")
            ids = copies.identities(whole.unionByName(fresh.select("session_id", "seq", "role", "text")))
            was = self.table("session_copies")
            seen = was.select("session_id", F.col("seen_at").alias("was"))
            ids = ids.join(seen, "session_id", "left").select("session_id", "hashes", "eligible", "imported", F.lit("").alias("duplicate_of"), F.coalesce("was", F.current_timestamp()).alias("seen_at"))
            out["session_copies"] = copies.without(was, changed).unionByName(ids)
            self.store.commit(out, more)
        return counts

    def _compare(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What is stored of a batch's sessions, and the action on each of them."""
        stored = self.table("messages").join(rows.select("session_id").distinct(), "session_id", "left_semi").select("session_id", "seq", "source", "project", "role", "text", "created_at")
        return stored, self.store.scratch(reconcile.classify_sessions(stored, rows))

    def _copies_of(self, owners: DataFrame) -> DataFrame:
        """Suppressed copies of some sessions, and the files they came from."""
        owned = self.table("session_copies").where("duplicate_of <> ''").join(owners.withColumnRenamed("session_id", "duplicate_of"), "duplicate_of", "left_semi")
        return self.store.scratch(owned.select("session_id").join(self.table("sessions").select("session_id", "path"), "session_id"))

    def ingest_files(self, paths: list[str], folders: dict | None = None) -> dict[str, int]:
        done = self.ingest(files.parse_files(self.spark, paths, folders), lambda more: files.parse_files(self.spark, more, folders))
        self.store.sweep()
        return done

    def _ids(self, *session_ids: str) -> DataFrame:
        return self.spark.createDataFrame([(s,) for s in session_ids], "session_id string")

    def _graph_without(self, ids: DataFrame) -> dict[str, DataFrame]:
        """The graph's tables without what some sessions gave them."""
        log = copies.without(self.table("msg_edges"), ids)
        indexed = self.table("indexed")
        gone = self.table("messages").join(ids, "session_id", "left_semi").join(indexed, ["session_id", "seq"], "left_semi")
        less = graph.project_df(graph.message_terms(gone, self.stemmer, typed=False)).withColumn("msgs", -F.col("msgs"))
        df = self.table("term_df").unionByName(less).groupBy("project", "term").agg(F.sum("msgs").alias("msgs")).where("msgs > 0")
        return {"msg_edges": log, "topic_edges": graph.topic_edges(log), "term_df": df, "indexed": copies.without(indexed, ids)}

    @writes
    def purge(self, sessions: DataFrame | str) -> None:
        """Takes sessions out of every table."""
        ids = self._ids(sessions) if isinstance(sessions, str) else sessions
        out = self._graph_without(ids)
        for name in ("messages", "sessions", "postings", "session_copies"):
            out[name] = copies.without(self.table(name), ids)
        self.store.commit(out)

    @writes
    def mark_no_ingest(self, session_id: str, path: str = "", tag: str = "private") -> None:
        row = self.spark.createDataFrame([(session_id, path, tag, datetime.now(UTC))], self.table("no_ingest").schema)
        self.store.commit({"no_ingest": copies.without(self.table("no_ingest"), row).unionByName(row)})
        self.purge(session_id)

    @writes
    def index_full(self, min_df: int = 2) -> dict[str, int]:
        """Builds the whole graph anew."""
        rows = self.table("messages")
        terms = graph.message_terms(rows, self.stemmer)
        log = graph.message_edges(rows, min_df, self.stemmer, terms=terms)
        edges = graph.topic_edges(log)
        out = {"msg_edges": log, "topic_edges": edges, "topics": graph.topics(edges, graph.labels(terms)), "term_df": graph.project_df(terms), "indexed": rows.select("session_id", "seq"), "meta": self._meta(graph_dirty="")}
        n = rows.count()
        self.store.commit(out)
        return {"messages": n, "pairs": self.table("msg_edges").where("kind = ''").count()}

    @writes
    def index_new(self, min_df: int = 2) -> dict[str, int]:
        """Adds messages that are not in the graph yet, by the frequencies of all; thresholds are those of the run."""
        meta = {r["key"]: r["value"] for r in self.table("meta").collect()}
        if meta.get("graph_dirty"):
            return {"messages": self.index_full(min_df)["messages"], "pairs": 0}
        rows = self.table("messages")
        fresh = rows.join(self.table("indexed"), ["session_id", "seq"], "left_anti")
        n = fresh.count()
        if not n:
            return {"messages": 0, "pairs": 0}
        terms = graph.message_terms(fresh, self.stemmer)
        df = self.table("term_df").unionByName(graph.project_df(terms)).groupBy("project", "term").agg(F.sum("msgs").alias("msgs"))
        said = graph.message_edges(fresh, min_df, self.stemmer, df=df, terms=terms).where("kind <> ''")
        top = graph.top_terms(terms, df, graph.hub_caps(rows, min_df), min_df)  # totals count all messages
        both = graph.message_pairs(top).select("session_id", "seq", "project", "term_a", "term_b", *(F.lit("").alias(c) for c in ("kind", "from_term", "to_term")), F.lit(None).cast("string").alias("evidence"))
        added = both.unionByName(said)
        edges = graph.merge_weights(self.table("topic_edges"), graph.topic_edges(added))
        known = self.table("topics")
        more = graph.topics(edges, graph.labels(terms)).join(known.select("topic_id"), "topic_id", "left_anti")
        n_pairs = both.count()
        self.store.commit({"topic_edges": edges, "term_df": df}, {"msg_edges": added, "topics": more, "indexed": fresh.select("session_id", "seq")})
        return {"messages": n, "pairs": n_pairs}

    def _meta(self, **values: str) -> DataFrame:
        now = {r["key"]: r["value"] for r in self.table("meta").collect()} | values
        return self.spark.createDataFrame(sorted(now.items()), "key string, value string")

    @writes
    def set_meta(self, **values: str) -> None:
        self.store.commit({"meta": self._meta(**values)})

    @writes
    def replace_edges(self, edges: DataFrame) -> None:
        """Seeds the graph: project, term_a, term_b, kind, from_term, to_term, weight, evidence, one row per edge."""
        kind = F.when(F.col("kind") == "", graph.COMENTION).otherwise(F.col("kind"))
        both = graph.directed(edges.withColumn("kind", kind))
        self.store.commit({"topic_edges": both, "topics": graph.topics(both, both.select("project", F.col("term_a").alias("term"), F.col("term_a").alias("label")).distinct())})

    @writes
    def suppress_copies(self) -> int:
        """Takes sessions out that are the beginning of another source's session, and remembers their owners."""
        known = self.table("session_copies").join(self.table("sessions").select("session_id", "source", "project"), "session_id")
        found = self.store.scratch(copies.suppress(known))
        n = found.count()
        if n:
            ids = found.select("session_id")
            out = self._graph_without(ids)
            for name in ("messages", "postings"):
                out[name] = copies.without(self.table(name), ids)
            marked = self.table("session_copies").join(found.withColumnRenamed("duplicate_of", "owner"), "session_id", "left").withColumn("duplicate_of", F.coalesce("owner", "duplicate_of")).drop("owner")
            self.store.commit(out | {"session_copies": marked})
        return n

    @writes
    def prepare_copies(self) -> int:
        """Identities of sessions that have none."""
        missing = self.table("sessions").join(self.table("session_copies"), "session_id", "left_anti").select("session_id")
        n = missing.count()
        if n:
            ids = copies.identities(self.table("messages").join(missing, "session_id")).withColumn("duplicate_of", F.lit("")).withColumn("seen_at", F.current_timestamp())
            self.store.commit({"session_copies": self.table("session_copies").unionByName(ids)})
        return n

    # Projects.

    def aliases(self) -> dict[str, str]:
        return {r["old_name"]: r["new_name"] for r in self.table("project_aliases").collect()}

    def project_stats(self) -> DataFrame:
        return projects.stats(self.table("sessions"), self.table("project_aliases"))

    def resolver(self) -> projects.Resolver:
        sizes = {r["project"]: r["sessions"] for r in self.project_stats().select("project", "sessions").collect()}
        known = {r["project"]: r.asDict() for r in self.table("project_identities").collect()}
        return projects.Resolver(sizes, self.aliases(), known)

    def resolve_project(self, request: str, probe: dict | None = None) -> projects.Resolution:
        return self.resolver().resolve(request, probe)

    def project_filter(self, request: str) -> ProjectFilter:
        """A name that nothing resolves is taken as a part of the value."""
        if not request:
            return EVERYTHING
        found = self.resolve_project(request)
        return ProjectFilter(substring=request) if found.reason == "none" else found.filter

    @writes
    def save_identity(self, project: str, repo_root: str = "", remote_url: str = "", common_dir: str = "") -> None:
        table = self.table("project_identities")
        row = self.spark.createDataFrame([(project, repo_root, remote_url, common_dir, datetime.now(UTC))], table.schema)
        self.store.commit({"project_identities": table.where(F.col("project") != project).unionByName(row)})

    @writes
    def rename_project(self, request: str, new: str) -> dict:
        """Gives a project another name in every table; two projects are never merged."""
        new = clean_path(new)
        if not request.strip() or not new:
            raise ValueError("rename needs both a current and a new project name")
        r = self.resolver()
        found = r.resolve(request)
        if found.reason not in ("exact", "alias", "basename", "identity") or len(found.matched) != 1:
            if same := r.same(request):
                found = projects.Resolution("exact", ProjectFilter(), same)
            if len(found.matched) != 1:
                raise LookupError(f"no one project is named {request!r}")
        old = found.matched[0]
        if old == new:
            raise ValueError("current and new project names are the same")
        if any(p.lower() == new.lower() and p != old for p in r.sizes):
            raise ValueError(f"a project named {new!r} already exists; a rename would merge them")
        names = ("sessions", "messages", "postings", "term_df", "msg_edges", "file_checkpoints", "project_identities")
        out = {n: projects.renamed(self.table(n), old, new) for n in names}
        out["topic_edges"] = projects.renamed_edges(self.table("topic_edges"), old, new)
        out["topics"] = projects.renamed_topics(self.table("topics"), old, new)
        aliases = {a: new if b == old else b for a, b in self.aliases().items() if a.lower() != new.lower()} | {old: new}
        out["project_aliases"] = self.spark.createDataFrame(sorted(aliases.items()), "old_name string, new_name string")
        self.store.commit(out)
        return {"old": old, "new": new, "sessions": r.sizes[old]}

    # Reads.

    def _stats(self) -> DataFrame:
        return postings.corpus_stats(self.table("messages"), self.table("postings"))

    def search_ranked(self, query: str, limit: int, where: ProjectFilter = EVERYTHING, source: str = "", expand: tuple[str, ...] = ()) -> DataFrame:
        """Hits in order: session_id, seq, source, project, role, snippet, created_at, score."""
        terms = ranking.query_terms(self.spark, query, self.stemmer)
        words = self.spark.createDataFrame([(query,)], "q string").select(text.content_words(F.col("q"))).first()[0]
        rows = self.table("messages")
        best = ranking.hybrid_rank(rows, self.table("postings"), self._stats(), terms, vectors.embed(words), limit, expand, where, source)
        hits = rows.join(F.broadcast(best), ["session_id", "seq"])  # at most ``limit`` rows
        return hits.select("session_id", "seq", "source", "project", "role", snippet_column(F.col("text"), [*terms, *expand]).alias("snippet"), "created_at", "score").orderBy(F.desc("score"), "session_id", "seq")

    def search(self, query: str, project: str = "", source: str = "", limit: int = 10) -> DataFrame:
        return self.search_ranked(query, limit, self.project_filter(project), source)

    def recall(self, query: str, project: str = "", source: str = "", limit: int = 5, per_session: int = 3) -> Recall:
        """The best sessions: those that the query names, then those of its hits, then what the graph leads to if
        there is room and the hits are exhausted."""
        if limit < 1 or per_session < 1:
            raise ValueError("limit must be positive")
        where = self.project_filter(project)
        terms = ranking.query_terms(self.spark, query, self.stemmer)
        near = self.expand(terms, where) if terms else []
        fetch = limit * per_session * 4
        hits = self.search_ranked(query, fetch, where, source).collect()
        out = [{"session_id": s, "hits": [], "named": True, "via_graph": False} for s in sessions.named(self.table("sessions"), query, where, source)[:limit]]
        known = {s["session_id"]: s for s in out}

        def add(found: list, via_graph: bool) -> None:
            for h in found:
                s = known.get(h["session_id"])
                if s is None:
                    if len(out) == limit:
                        continue
                    s = known[h["session_id"]] = {"session_id": h["session_id"], "hits": [], "named": False, "via_graph": via_graph}
                    out.append(s)
                elif s["via_graph"] != via_graph:
                    continue
                if len(s["hits"]) < per_session and h["snippet"] not in [x["snippet"] for x in s["hits"]]:
                    s["hits"].append(h.asDict())

        add(hits, False)
        if len(out) < limit and len(hits) < fetch and near:
            add(self.search_ranked(query, fetch, where, source, tuple(t["term"] for t in near)).collect(), True)
        if out:
            ids = list(known)
            rows = self.table("messages").where(F.col("session_id").isin(*ids))
            heads = {r["session_id"]: r.asDict() for r in sessions.describe(rows, self.table("sessions").where(F.col("session_id").isin(*ids))).collect()}
            ends: dict[str, list] = {}
            for r in sessions.endings(rows).orderBy("session_id", "seq").collect():
                ends.setdefault(r["session_id"], []).append(r.asDict())
            for s in out:
                s.update({k: v for k, v in heads.get(s["session_id"], {}).items() if k != "session_id"} | {"ending": ends.get(s["session_id"], [])})
        return Recall(out, near)

    def expand(self, terms: list[str], where: ProjectFilter = EVERYTHING, n: int = 6) -> list[dict]:
        rows = graph.expand(self.table("topic_edges"), self.table("term_df"), terms, n, where).collect()
        named = self._labels([r["term"] for r in rows])
        return [r.asDict() | {"label": named.get(r["term"], r["term"])} for r in rows]

    def _labels(self, terms: list[str]) -> dict[str, str]:
        if not terms:
            return {}
        rows = self.table("topics").where(F.col("term").isin(*terms)).groupBy("term").agg(F.max("label").alias("label"))
        return {r["term"]: r["label"] for r in rows.collect() if r["label"]}

    def related(self, term: str, project: str = "", depth: int = 1, limit: int = 20) -> list[dict]:
        """Topics about a term, under the words that people use for them."""
        term = term.strip().lower()
        if not term:
            raise ValueError("related needs a term")
        stem = porter.stem(term) if self.stemmer == "porter" else term
        rows = [r.asDict() for r in graph.related(self.table("topic_edges"), stem, depth, limit, self.project_filter(project)).collect()]
        named = self._labels(sorted({r[k] for r in rows for k in ("term", "via", "from_term", "to_term")} - {""}))
        return [r | {k: named.get(r[k], r[k]) for k in ("term", "via", "from_term", "to_term")} for r in rows]

    def resolve_session(self, reference: str) -> str:
        return sessions.resolve(self.table("sessions"), self.table("session_copies"), reference)

    def window(self, session_id: str, first: int, last: int, keep: int = -1, with_context: bool = False) -> DataFrame:
        owner = self.table("session_copies").where((F.col("session_id") == session_id) & (F.col("duplicate_of") != "")).select("duplicate_of").first()
        return sessions.window(self.table("messages"), owner[0] if owner else session_id, first, last, keep, with_context)

    def session(self, session_id: str) -> dict | None:
        row = self.table("sessions").where(F.col("session_id") == session_id).first()
        return row.asDict() if row else None

    def last_message(self, session_id: str) -> dict | None:
        row = self.table("messages").where(F.col("session_id") == session_id).orderBy(F.desc("seq")).limit(1).first()
        return row.asDict() if row else None

    def counts(self) -> dict[str, int]:
        return {name: self.table(name).count() for name in ("sessions", "messages")}

    def show(self, reference: str, context: int | None = None, around: int | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
        """Messages of a session: the first twenty, those round one of them, or a range."""
        low, high = (max(0, around - (context or 0)), around + (context or 0)) if around is not None else (first or 0, last if last is not None else (first or 0) + 19)
        return self.window(self.resolve_session(reference), low, high, -1 if around is None else around)

    @writes
    def backfill_sessions(self) -> None:
        """Placeholders and update times for sessions of older versions."""
        newest = self.table("messages").groupBy("session_id").agg(F.max("created_at").alias("newest"))
        rows = self.table("sessions").join(newest, "session_id", "left")
        unknown = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "Unknown").otherwise(F.col(c)).alias(c)
        out = rows.select("session_id", "source", "project", "started_at", "path", unknown("model"), unknown("effort"), F.coalesce("updated_at", "newest").alias("updated_at"))
        self.store.commit({"sessions": out})

    @writes
    def ensure_schemas(self) -> list[str]:
        """Rebuilds derived tables that an older version made; returns which."""
        now = {r["key"]: r["value"] for r in self.table("meta").collect()}
        done = []
        if now.get("terms_schema") != TERMS_SCHEMA:
            self.store.commit({"postings": postings.build_postings(self.table("messages"), self.stemmer), "meta": self._meta(terms_schema=TERMS_SCHEMA)})
            done.append("postings")
        if now.get("edges_schema") != EDGES_SCHEMA:
            self.index_full()
            self.set_meta(edges_schema=EDGES_SCHEMA)
            done.append("graph")
        return done

    def relocate(self, target: str, probe: str = "") -> dict[str, int]:
        """A verified copy of the store in another folder, which must answer a search before it counts."""
        done = self.store.repack(target)
        copy = Engine(self.spark, target, self.stemmer, create=False)
        if copy.counts() != self.counts():
            raise OSError("the copy has other rows than the store")
        if probe and [r[:2] for r in copy.search(probe).collect()] != [r[:2] for r in self.search(probe).collect()]:
            raise OSError("the copy gives other results than the store")
        return done

    def repack(self, target: str | None = None) -> dict[str, int]:
        return self.store.repack(target)
