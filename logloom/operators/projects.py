"""Projects: statistics, resolution of names, aliases and renames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import MIN_SCORE, base_name, clean_path, name_score
from .filters import ProjectFilter
from .graph import PART, STEP

MAX_HOPS = 16


def stats(sessions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """project, sessions, first_at, last_at, sources, aliases; most sessions first."""
    told = sessions.where("project <> ''").groupBy("project").agg(F.count("*").alias("sessions"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"), F.sort_array(F.collect_set("source")).alias("sources"))
    if aliases is not None:
        told = told.join(aliases.groupBy(F.col("new_name").alias("project")).agg(F.sort_array(F.collect_set("old_name")).alias("aliases")), "project", "left")
    return told.orderBy(F.desc("sessions"), "project")


def _fold(value: str) -> str:
    return clean_path(value).lower()


def identity_key(identity: dict) -> str:
    """What makes two project values one repository: the remote, else the common directory, else the root."""
    if remote := identity.get("remote_url"):
        return "remote:" + remote.lower()
    return next((f"{kind}:{_fold(identity[name])}" for kind, name in (("common", "common_dir"), ("root", "repo_root")) if identity.get(name)), "")


def follow_alias(aliases: dict[str, str], name: str) -> str:
    """The end of a chain of aliases, whose keys are folded; cycles and long chains stop."""
    seen: set[str] = set()
    while len(seen) < MAX_HOPS and (key := _fold(name)) not in seen and key in aliases:
        seen.add(key)
        name = aliases[key]
    return name


@dataclass(frozen=True)
class Resolution:
    reason: str  # exact, alias, basename, identity, substring or none
    filter: ProjectFilter
    matched: list[str] = field(default_factory=list)
    ambiguous: bool = False
    identity: str = ""
    candidates: list[tuple[str, float, int]] = field(default_factory=list)
    stale_path: bool = False


class Resolver:
    """Finds the projects that a request means, from small tables: the sessions of each project, aliases (old name to
    new) and identities (project to repo_root, remote_url and common_dir)."""

    def __init__(self, sizes: dict[str, int], aliases: dict[str, str] | None = None, identities: dict[str, dict] | None = None):
        self.sizes, self.identities = sizes, identities or {}
        self.given = dict(aliases or {})
        self.aliases = {_fold(old): new for old, new in self.given.items()}

    def ordered(self, found: set[str] | list[str]) -> list[str]:
        return sorted(found, key=lambda p: (-self.sizes[p], p))

    def same(self, name: str) -> list[str]:
        return [p for p in self.sizes if _fold(p) == _fold(name)]

    def of_repository(self, key: str) -> list[str]:
        """Stored projects of a repository, one for each spelling apart from case."""
        known = {_fold(p) for p, i in self.identities.items() if key and identity_key(i) == key}
        return list({p.lower(): p for p in reversed(self.ordered([p for p in self.sizes if _fold(p) in known]))}.values())

    def renamed_to(self, request: str) -> str | None:
        """Where a former name leads; a bare name counts if all former names that end in it lead to one place."""
        if (after := self.aliases.get(_fold(request))) is not None:
            return follow_alias(self.aliases, after)
        last = base_name(request).lower()
        ends = {t.lower(): t for old, new in self.aliases.items() if last and base_name(old).lower() == last for t in [follow_alias(self.aliases, new)]}
        return next(iter(ends.values())) if len(ends) == 1 else None

    def named_repository(self, request: str, probe: dict | None) -> str:
        """The one repository that the request names by its folder, its address or its address's last name."""
        if probe and self.of_repository(key := identity_key(probe)):
            return key
        whole, last = _fold(request), base_name(request).lower()
        keys = set()
        for i in self.identities.values():
            remote = i.get("remote_url") or ""
            spelled = {_fold(i.get("repo_root") or ""), _fold(i.get("common_dir") or ""), remote.lower()} - {""}
            if whole in spelled or (last and remote and base_name(remote).lower() == last):
                keys.add(identity_key(i))
        return keys.pop() if len(keys) == 1 else ""

    def candidates(self, request: str, n: int = 3) -> list[tuple[str, float, int]]:
        """Projects with a name like the request's: (project, score, sessions)."""
        out = []
        for p, size in self.sizes.items():
            names = [p, *(old for old, new in self.given.items() if new == p), self.identities.get(p, {}).get("remote_url") or ""]
            if (score := max(name_score(request, x) for x in names)) >= MIN_SCORE:
                out.append((p, score, size))
        return sorted(out, key=lambda x: (-x[1], -x[2], x[0]))[:n]

    def resolve(self, request: str, probe: dict | None = None, exists: bool = True) -> Resolution:
        """The first rule that finds something decides. ``probe`` is what git says of the request's folder, and
        ``exists`` whether a request that is a path is there."""
        if not request.strip():
            return Resolution("exact", ProjectFilter())
        target = self.renamed_to(request)
        last = base_name(request).lower()
        for reason, found in (("exact", self.same(request)), ("alias", self.same(target) if target else []), ("basename", [p for p in self.sizes if last and base_name(p).lower() == last])):
            if len(found) == 1:
                own = next((i for p, i in self.identities.items() if _fold(p) == _fold(found[0])), None)
                group = self.of_repository(identity_key(own)) if own else []
                if len(group) > 1:
                    return self._told("identity", group, identity=identity_key(own))
            if found:
                return self._told(reason, found, ambiguous=len(found) > 1)
        if key := self.named_repository(request, probe):
            if group := self.of_repository(key):
                return self._told("identity", group, identity=key)
        part = [p for p in self.sizes if request.strip().lower() in p.lower()]
        if part:
            return self._told("substring", part, ambiguous=len(part) > 1)
        is_path = "/" in clean_path(request)
        return Resolution("none", ProjectFilter(no_match=True), candidates=self.candidates(request), stale_path=is_path and not exists)

    def _told(self, reason: str, found: list[str], **more) -> Resolution:  # noqa: ANN003
        found = self.ordered(found)
        return Resolution(reason, ProjectFilter(values=tuple(found)), found, **more)

    def shared(self) -> dict[str, list[str]]:
        """Projects of one repository, by its key, where there are several."""
        keys = {identity_key(i) for i in self.identities.values()} - {""}
        return {k: self.ordered(g) for k in sorted(keys) if len(g := self.of_repository(k)) > 1}


def renamed(table: DataFrame, old: str, new: str) -> DataFrame:
    return table.withColumn("project", F.when(F.col("project") == old, new).otherwise(F.col("project")))


def renamed_edges(edges: DataFrame, old: str, new: str) -> DataFrame:
    """Edges under the new name, with ids made anew."""
    rows = renamed(edges, old, new)
    src, dst = (F.concat_ws(PART, "project", c) for c in ("term_a", "term_b"))
    return rows.withColumn("src_id", src).withColumn("dst_id", dst).withColumn("edge_id", F.concat_ws(STEP, "src_id", "dst_id", "kind", "from_term", "to_term")).select(*edges.columns)


def renamed_topics(topics: DataFrame, old: str, new: str) -> DataFrame:
    return renamed(topics, old, new).withColumn("topic_id", F.concat_ws(PART, "project", "term")).select(*topics.columns)


def apply_aliases(table: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Project values under the names that their aliases lead to."""
    if not aliases:
        return table
    folded = {_fold(old): new for old, new in aliases.items()}
    ends = {old: follow_alias(folded, old) for old in aliases}
    pairs = [F.lit(x) for item in ends.items() for x in item]
    return table.withColumn("project", F.coalesce(F.element_at(F.create_map(*pairs), F.col("project")), F.col("project")))
