"""The topic graph: co-mentioned and related terms, for each project.

``message_terms`` has a row per message with its distinct stems in order, its typed relations (stemmed) and its
labels. Frequencies are joined to terms, each message keeps its twelve most distinctive terms, and their pairs are
counted; a message's terms stay together from there on, so pairs are made without a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.porter import stem_all
from ..functions.text import content_terms, typed_relations
from .filters import EVERYTHING, ProjectFilter
from .postings import KEY

MAX_DF_RATIO = 0.25
TOP_TERMS = 12
MAX_VIA = 8
MIN_TYPED = 2
COMENTION = "co-mention"
PART, STEP = "\x1f", "\x1e"


def message_terms(messages: DataFrame, stemmer: str = "porter", typed: bool = True) -> DataFrame:
    """session_id, seq, project, words, stems (of the words, aligned), typed."""
    rows = messages.select(*KEY, "project", content_terms(F.col("text")).alias("words"), (typed_relations(F.col("text")) if typed else F.array()).alias("raw"))
    rows = rows.withColumn("stems", stem_all(F.col("words")) if stemmer == "porter" else F.col("words"))
    if not typed:
        return rows.select(*KEY, "project", "words", "stems", F.expr("cast(array() as array<struct<from_term:string,to_term:string,kind:string,evidence:string>>)").alias("typed"))
    ends = (F.transform("raw", lambda r: r[name]) for name in ("from_term", "to_term"))
    a, b = (stem_all(e) if stemmer == "porter" else e for e in ends)
    rows = rows.withColumn("a", a).withColumn("b", b)
    made = F.expr("filter(transform(raw, (r, i) -> named_struct('from_term', a[i], 'to_term', b[i], 'kind', r.kind, 'evidence', r.evidence)), r -> r.from_term <> r.to_term)")
    return rows.select(*KEY, "project", "words", "stems", made.alias("typed"))


def project_df(terms: DataFrame) -> DataFrame:
    """project, term, msgs: messages of a project that hold a term."""
    return terms.select("project", F.explode(F.array_distinct("stems")).alias("term")).groupBy("project", "term").agg(F.count("*").alias("msgs"))


def hub_caps(messages: DataFrame, min_df: int) -> DataFrame:
    """project, total, cap: above the cap a term is a hub; corpora too small for a cap have none."""
    cap = F.floor(F.col("total") * MAX_DF_RATIO)
    return messages.groupBy("project").agg(F.count("*").alias("total")).withColumn("cap", F.when(cap >= min_df, cap).otherwise(F.col("total")))


def top_terms(terms: DataFrame, df: DataFrame, caps: DataFrame, min_df: int, top: int = TOP_TERMS) -> DataFrame:
    """session_id, seq, project, term, place: each message's most distinctive terms."""
    fit = df.join(caps.select("project", "cap"), "project").where((F.col("msgs") >= min_df) & (F.col("msgs") <= F.col("cap"))).select("project", "term", "msgs")
    each = terms.select(*KEY, "project", F.explode(F.array_distinct("stems")).alias("term")).join(fit, ["project", "term"])
    order = Window.partitionBy(*KEY, "project").orderBy("msgs", "term")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select(*KEY, "project", "term", "place")


def message_pairs(top: DataFrame) -> DataFrame:
    """session_id, seq, project, term_a, term_b: all pairs of a message's kept terms, at most 66."""
    kept = top.groupBy(*KEY, "project").agg(F.array_sort(F.collect_list("term")).alias("t"))
    pairs = F.expr("flatten(transform(t, (a, i) -> transform(slice(t, i + 2, size(t)), b -> named_struct('term_a', a, 'term_b', b))))")
    return kept.select(*KEY, "project", F.explode(pairs).alias("p")).select(*KEY, "project", "p.term_a", "p.term_b")


def message_edges(messages: DataFrame, min_df: int = 2, stemmer: str = "porter", typed: bool = True, df: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """The log of edges, one row per unit of weight; the kind of co-mentions is empty there."""
    terms = message_terms(messages, stemmer, typed) if terms is None else terms
    pairs = message_pairs(top_terms(terms, project_df(terms) if df is None else df, hub_caps(messages, min_df), min_df))
    empty = F.lit("")
    both = pairs.select(*KEY, "project", "term_a", "term_b", empty.alias("kind"), empty.alias("from_term"), empty.alias("to_term"), F.lit(None).cast("string").alias("evidence"))
    said = terms.select(*KEY, "project", F.explode("typed").alias("r")).select(
        *KEY, "project", F.least("r.from_term", "r.to_term").alias("term_a"), F.greatest("r.from_term", "r.to_term").alias("term_b"), "r.kind", "r.from_term", "r.to_term",
        F.concat("session_id", F.lit("#"), F.col("seq").cast("string"), F.lit(": "), "r.evidence").alias("evidence"))
    return both.unionByName(said)


def topic_edges(log: DataFrame) -> DataFrame:
    """The log rolled up, every edge in both directions."""
    kind = F.when(F.col("kind") == "", COMENTION).otherwise(F.col("kind"))
    rolled = log.groupBy("project", "term_a", "term_b", kind.alias("kind"), "from_term", "to_term").agg(F.count("*").alias("weight"), F.min_by("evidence", F.struct("session_id", "seq")).alias("evidence"))
    return directed(rolled)


def directed(rolled: DataFrame) -> DataFrame:
    ways = F.explode(F.array(F.struct(F.col("term_a").alias("src"), F.col("term_b").alias("dst")), F.struct(F.col("term_b").alias("src"), F.col("term_a").alias("dst"))))
    rows = rolled.select("*", ways.alias("way")).select("*", F.concat_ws(PART, "project", "way.src").alias("src_id"), F.concat_ws(PART, "project", "way.dst").alias("dst_id"))
    edge = F.concat_ws(STEP, "src_id", "dst_id", "kind", "from_term", "to_term")
    return rows.select(edge.alias("edge_id"), "src_id", "dst_id", "project", F.col("way.src").alias("term_a"), F.col("way.dst").alias("term_b"), "weight", "kind", "from_term", "to_term", F.coalesce("evidence", F.lit("")).alias("evidence"))


def labels(terms: DataFrame) -> DataFrame:
    """project, term, label: a stem's most frequent word; of equals the shortest in bytes, then the first."""
    each = terms.select("project", F.explode(F.arrays_zip("stems", "words")).alias("z")).select("project", F.col("z.stems").alias("term"), F.col("z.words").alias("word"))
    votes = each.groupBy("project", "term", "word").agg(F.count("*").alias("n"))
    return votes.groupBy("project", "term").agg(F.min_by("word", F.struct(-F.col("n"), F.octet_length("word"), F.col("word"))).alias("label"))


def topics(edges: DataFrame, named: DataFrame) -> DataFrame:
    """topic_id, project, term, label of all ends of edges."""
    ends = edges.select("project", F.col("term_a").alias("term")).distinct()
    return ends.join(named, ["project", "term"], "left").select(F.concat_ws(PART, "project", "term").alias("topic_id"), "project", "term", F.coalesce("label", "term").alias("label"))


def neighbours(edges: DataFrame, term: str, where: ProjectFilter = EVERYTHING) -> DataFrame:
    """One hop: term, weight, kind, from_term, to_term, evidence, summed over projects."""
    rows = edges.where((F.col("term_a") == term) & where.column(F.col("project")))
    return rows.groupBy(F.col("term_b").alias("term"), "kind", "from_term", "to_term").agg(F.sum("weight").alias("weight"), F.min("evidence").alias("evidence"))


def two_hops(edges: DataFrame, term: str, where: ProjectFilter = EVERYTHING) -> DataFrame:
    """via, term, weight of the second edges for every path, kind, from_term, to_term, evidence."""
    first = edges.where((F.col("term_a") == term) & where.column(F.col("project"))).select(F.col("dst_id").alias("hop"), F.col("term_b").alias("via"))
    rows = edges.where(F.col("term_b") != term).join(first, F.col("src_id") == F.col("hop"))
    return rows.groupBy("via", F.col("term_b").alias("term"), "kind", "from_term", "to_term").agg(F.sum("weight").alias("weight"), F.min("evidence").alias("evidence"))


def related_order() -> list:
    typed = (F.col("kind") != COMENTION) & (F.col("kind") != "") & (F.col("weight") >= MIN_TYPED)
    return [F.when(typed, 0).otherwise(1), F.desc("weight"), "term", "kind", "from_term", "to_term", "via"]


def related(edges: DataFrame, term: str, depth: int = 1, limit: int = 20, where: ProjectFilter = EVERYTHING) -> DataFrame:
    """term, weight, kind, from_term, to_term, via, evidence: direct neighbours, and at depth two what the eight
    strongest of them lead to."""
    if limit < 1 or depth not in (1, 2):
        raise ValueError("related needs a positive limit and depth 1 or 2")
    if not term:
        raise ValueError("related needs a term")
    key = ["term", "kind", "from_term", "to_term"]
    direct = neighbours(edges, term, where).select(*key, "weight", F.lit("").alias("via"), "evidence")
    out = direct
    if depth == 2:
        strong = direct.groupBy("term").agg(F.max("weight").alias("w1")).orderBy(F.desc("w1"), "term").limit(MAX_VIA).select(F.col("term").alias("via"), "w1")
        far = two_hops(edges, term, where).join(F.broadcast(strong), "via").join(direct.select(*key).distinct(), key, "left_anti")  # eight rows
        best = far.withColumn("weight", F.col("weight") + F.col("w1")).groupBy(*key).agg(F.min(F.struct((-F.col("weight")).alias("less"), "via", "evidence")).alias("y"))
        out = out.unionByName(best.select(*key, (-F.col("y.less")).alias("weight"), "y.via", "y.evidence"))
    return out.orderBy(*related_order()).limit(limit).select("term", "weight", "kind", "from_term", "to_term", "via", "evidence")


def expand(edges: DataFrame, df: DataFrame, stems: list[str], n: int = 6, where: ProjectFilter = EVERYTHING) -> DataFrame:
    """term, links, weight, lift: the most specific neighbours of a query's terms, by recurring edges or, failing
    those, by any."""
    rows = edges.where((F.col("kind") == COMENTION) & F.col("term_a").isin(*stems) & ~F.col("term_b").isin(*stems) & where.column(F.col("project")))
    each = rows.select("project", F.col("term_a").alias("src"), F.col("term_b").alias("term"), "weight").join(df, ["project", "term"])
    lift = F.col("weight").cast("double") / F.greatest("msgs", F.lit(1))
    often = F.col("weight") >= 2
    told = each.groupBy("term").agg(
        F.count_distinct("src").alias("l1"), F.sum("weight").alias("w1"), F.sum(lift).alias("f1"),
        F.count_distinct(F.when(often, F.col("src"))).alias("l2"), F.sum(F.when(often, F.col("weight"))).alias("w2"), F.sum(F.when(often, lift)).alias("f2"))
    fit = lambda k: told.where(F.col(f"w{k}").isNotNull()).select("term", F.col(f"l{k}").alias("links"), F.col(f"w{k}").alias("weight"), F.round(f"f{k}", 12).alias("lift")).orderBy(F.desc("links"), F.desc("lift"), "term").limit(n)
    strong = fit(2)
    weak = fit(1).join(strong.agg(F.count("*").alias("found")), how="cross").where("found = 0").drop("found")  # one row
    return strong.unionByName(weak)


def undo(log: DataFrame, session_ids: list[str]) -> DataFrame:
    """The log without what some sessions gave it; rolled up again, edges without weight are gone."""
    return log.where(~F.col("session_id").isin(*session_ids))


def merge_weights(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Rolled-up edges with more weight; what was first seen keeps its evidence."""
    key = ["edge_id", "src_id", "dst_id", "project", "term_a", "term_b", "kind", "from_term", "to_term"]
    rows = stored.withColumn("new", F.lit(0)).unionByName(added.withColumn("new", F.lit(1)))
    return rows.groupBy(*key).agg(F.sum("weight").alias("weight"), F.min_by("evidence", "new").alias("evidence")).where("weight > 0").select(*stored.columns)
