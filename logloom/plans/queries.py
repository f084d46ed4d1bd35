"""Registered queries over message tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text, vectors
from ..functions.porter import porter_stem
from ..functions.snippets import snippet_column
from ..operators import copies, graph, postings, projects, ranking, reconcile, sessions
from ..operators.filters import ProjectFilter
from ..session import ship
from . import testdata as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TERMS = ("the", "onth", "dieein", "und", "que")
WORDS = {"the": 1.0, "onth": 1.0, "dieein": 1.0, "tion": 0.3}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = lambda spark, d: (ship(spark), f(spark, d))[1]
        if sql:
            SQL[name] = sql
        return f

    return keep


def _corpus(spark: SparkSession, d: str, of: Callable = t.conversations) -> tuple[DataFrame, DataFrame, DataFrame]:
    messages = of(spark, d)
    post = postings.build_postings(messages, "identity")
    return messages, post, postings.text_stats(messages)


WITH = "with " + t.CONVERSATIONS
POSTINGS = WITH + ", " + t.postings_sql("conv")
STATS = "st as (select (select count(*) from conv) as n, (select sum(tf) from post) as total)"


def bm25_sql(weights: dict[str, float], where: str = "true", base: str = POSTINGS, messages: str = "ctx") -> str:
    values = ", ".join(f"('{k}', {v})" for k, v in weights.items())
    return f"""{base}, {STATS.replace("conv", "ctx" if messages == "ctx" else messages)}, qt as (select * from (values {values}) v(term, qw)),
df as (select term, count(*) as df from post join qt using (term) group by term), dl as (select session_id, seq, sum(tf) as dl from post group by all),
bm as (select m.session_id, m.seq, round(sum(qw * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n)))), 9) as score
  from post join qt using (term) join df using (term) join dl using (session_id, seq) join {messages} m using (session_id, seq), st where {"not context and " if messages == "ctx" else ""}{where} group by all)"""


@query("tokenize_postings", POSTINGS + " select session_id, seq, term, tf from post")
def tokenize_postings(spark: SparkSession, d: str) -> DataFrame:
    return postings.term_frequencies(t.conversations(spark, d), "identity")


@query("term_df_global", POSTINGS + " select term, count(*) as df from post group by term")
def term_df_global(spark: SparkSession, d: str) -> DataFrame:
    return postings.document_frequency(_corpus(spark, d)[1])


@query("doc_length", POSTINGS + " select session_id, seq, cast(sum(tf) as bigint) as dl from post group by all")
def doc_length(spark: SparkSession, d: str) -> DataFrame:
    return postings.document_length(_corpus(spark, d)[1])


@query("corpus_stats", POSTINGS + " select (select count(*) from conv) as n_messages, (select cast(sum(tf) as bigint) from post) as n_words")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    messages, post, _ = _corpus(spark, d)
    return postings.corpus_stats(messages, post)


@query("postings_append", "with " + t.CONVERSATIONS + ", old as (select * from conv where seq < 2), " + t.postings_sql("conv") + " select session_id, seq, term, tf from post anti join old using (session_id, seq)")
def postings_append(spark: SparkSession, d: str) -> DataFrame:
    messages = t.conversations(spark, d)
    return postings.append_new(postings.build_postings(messages.where("seq < 2"), "identity"), messages, "identity").select("session_id", "seq", "term", "tf")


@query("bm25_scores", bm25_sql(WORDS) + " select session_id, seq, score from bm")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    _, post, stats = _corpus(spark, d)
    return ranking.bm25_scores(post, F.col("n_messages"), F.col("n_words"), stats, WORDS).select("session_id", "seq", F.round("score", 9).alias("score"))


@query("bm25_topk", bm25_sql(dict.fromkeys(TERMS, 1.0)) + " select session_id, seq, role, project, source, score from bm join conv using (session_id, seq) order by score desc, session_id, seq limit 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best messages for a text query."""
    messages, post, stats = _corpus(spark, d)
    scored = ranking.bm25_scores(post, F.col("n_messages"), F.col("n_words"), stats, dict.fromkeys(TERMS, 1.0))
    best = scored.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "session_id", "seq").limit(10)
    return messages.join(F.broadcast(best), ["session_id", "seq"]).select("session_id", "seq", "role", "project", "source", "score")  # ten rows


@query("bm25_filtered", bm25_sql(dict.fromkeys(TERMS, 1.0), "lower(m.project) in ('p1', 'p2') and m.source = 's1'") + " select session_id, seq, score from bm order by score desc, session_id, seq limit 20")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    _, post, stats = _corpus(spark, d)
    scored = ranking.bm25_scores(post, F.col("n_messages"), F.col("n_words"), stats, dict.fromkeys(TERMS, 1.0), ProjectFilter(values=("P1", "p2")), "s1")
    return scored.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "session_id", "seq").limit(20)


@query("bm25_documents", bm25_sql(WORDS, base="with " + t.DOCUMENTS + ", " + t.postings_sql("docs"), messages="docs").replace("select count(*) from docs", "select count(*) from docs") + " select session_id, seq, score from bm order by score desc, session_id, seq limit 50")
def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    _, post, stats = _corpus(spark, d, t.documents)
    scored = ranking.bm25_scores(post, F.col("n_messages"), F.col("n_words"), stats, WORDS)
    return scored.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "session_id", "seq").limit(50)


PROBE = [round(((i * 37) % 101 - 50) / 100, 6) for i in range(64)]
VECTORS = f"""with probe as (select cast({PROBE} as double[]) as q),
far as (select cast(vec_id as varchar) as session_id, 0 as seq, 's' || (vec_id % 3) as source, 'p' || label as project,
  round(1 - list_dot_product(cast(embedding as double[]), q) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) * sqrt(list_dot_product(q, q))), 9) as distance from embeddings, probe)"""


def _near(spark: SparkSession, d: str, limit: int, cutoff: float, where: ProjectFilter | None = None) -> DataFrame:
    rows = ranking.vector_rank(t.vectors(spark, d), PROBE, limit, where or ProjectFilter(), cutoff=cutoff)
    return rows.withColumn("distance", F.round("distance", 9))


@query("vector_topk", VECTORS + " select session_id, seq, distance from far order by distance, session_id, seq limit 50")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 50, 2.0)


@query("vector_cutoff", VECTORS + " select * from (select session_id, seq, distance from far where project = 'p1' order by distance, session_id, seq limit 60) where distance <= 0.95")
def vector_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 60, 0.95, ProjectFilter(values=("p1",)))


_RRF = bm25_sql(dict.fromkeys(TERMS, 1.0)) + """, k as (select * from bm order by score desc, session_id, seq limit 500),
near as (select c.session_id, c.seq, round(abs(length(text) - 300) / 1000.0, 9) as distance from conv c order by 3, 1, 2 limit 200), v as (select near.* from near semi join k using (session_id, seq) where distance <= 0.65),
parts as (select session_id, seq, 1.0::double / (60 + rank() over (order by score desc)) as part from k union all select session_id, seq, 1.0::double / (60 + rank() over (order by distance)) from v)"""


@query("rrf_fusion", _RRF + " select session_id, seq, round(sum(part), 9) as score from parts group by all order by score desc, session_id, seq limit 40")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Keywords fused with a second ranking, here by closeness of length."""
    messages, post, stats = _corpus(spark, d)
    scored = ranking.bm25_scores(post, F.col("n_messages"), F.col("n_words"), stats, dict.fromkeys(TERMS, 1.0))
    keyword = scored.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "session_id", "seq").limit(500)
    near = messages.select("session_id", "seq", F.round(F.abs(F.length("text") - 300) / 1000.0, 9).alias("distance")).orderBy("distance", "session_id", "seq").limit(200).where("distance <= 0.65")
    return ranking.fuse(keyword, near).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "session_id", "seq").limit(40)


def _embedded(messages: DataFrame) -> DataFrame:
    return messages.withColumn("embedding", vectors.embed_words(text.content_words(F.col("text"))))


SEARCH = "onth dieein tion the"


@query("search_hybrid")
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Stemmed keywords and hashed phrases, fused, with snippets."""
    messages = _embedded(t.conversations(spark, d))
    post = postings.build_postings(messages)
    terms = ranking.query_terms(spark, SEARCH)
    vector = vectors.embed([w for w in SEARCH.split() if text.is_content(w)])
    best = ranking.hybrid_rank(messages, post, postings.corpus_stats(messages, post), terms, vector, 20)
    hits = messages.join(F.broadcast(best), ["session_id", "seq"])  # twenty rows
    return hits.select("session_id", "seq", "role", F.round("score", 9).alias("score"), snippet_column(F.col("text"), terms).alias("snippet"))


@query("recall_sessions", bm25_sql(dict.fromkeys(TERMS, 1.0)) + """, hits as (select * from bm order by score desc, session_id, seq limit 60),
r as (select *, row_number() over (order by score desc, session_id, seq) as place from hits), g as (select *, row_number() over (partition by session_id order by place) as hit_rank, min(place) over (partition by session_id) as best from r)
select session_id, seq, score, session_rank, hit_rank from (select *, dense_rank() over (order by best) as session_rank from g) where session_rank <= 5 and hit_rank <= 3""")
def recall_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The best sessions, each with its best hits."""
    _, post, stats = _corpus(spark, d)
    scored = ranking.bm25_scores(post, F.col("n_messages"), F.col("n_words"), stats, dict.fromkeys(TERMS, 1.0))
    hits = scored.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "session_id", "seq").limit(60).withColumn("snippet", F.concat_ws("#", "session_id", "seq"))
    return sessions.group_hits(hits, 5, 3).select("session_id", "seq", "score", F.col("session_rank").cast("long"), F.col("hit_rank").cast("long"))


PROMPT = "(role = 'user' and not context)"


@query("session_titles", WITH + f" select session_id, min_by(text, seq) filter ({PROMPT}) as title, count(*) as messages from ctx group by session_id")
def session_titles(spark: SparkSession, d: str) -> DataFrame:
    return sessions.describe(t.conversations(spark, d)).select("session_id", "title", "messages")


@query("session_endings", WITH + f""", mk as (select session_id, max(seq) filter ({PROMPT}) as lu, max(seq) filter (role = 'assistant') as la from ctx group by session_id)
select c.session_id, c.seq, c.role, c.text from conv c join mk using (session_id) where c.seq = lu or c.seq = la or (c.role = 'note' and c.seq > coalesce(greatest(lu, la), -1))""")
def session_endings(spark: SparkSession, d: str) -> DataFrame:
    return sessions.endings(t.conversations(spark, d))


@query("message_window", WITH + " select session_id, seq, role, text from ctx where session_id = '12' and seq between 0 and 4 and (seq = 9 or not context)")
def message_window(spark: SparkSession, d: str) -> DataFrame:
    return sessions.window(t.conversations(spark, d), "12", 0, 4, keep=9).select("session_id", "seq", "role", "text")


@query("resolve_prefix", WITH + ", s as (select distinct source || ':' || session_id as session_id from conv) select session_id from s where starts_with(session_id, '7') or starts_with(split_part(session_id, ':', 2), '7') order by session_id limit 6")
def resolve_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = t.sessions(t.conversations(spark, d)).select(F.concat_ws(":", "source", "session_id").alias("session_id"))
    return sessions.with_prefix(rows, "7")


def literal(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


TERMS_SQL = "with " + t.DOCUMENTS + f""", cw as materialized (select session_id, seq, project, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+')) as term from docs),
terms as materialized (select distinct session_id, seq, project, term from cw where strlen(term) >= 3 and term not in ({literal(text.STOPWORDS)}) and not regexp_matches(term, '^\\p{{Nd}}+$')),
pdf as materialized (select project, term, count(*) as msgs from terms group by all),
caps as materialized (select project, count(*) as total, case when floor(count(*) * 0.25) >= 2 then cast(floor(count(*) * 0.25) as bigint) else count(*) end as cap from docs group by project),
top as materialized (select * from (select session_id, seq, project, term, row_number() over (partition by session_id, seq, project order by msgs, term) as place
  from terms join pdf using (project, term) join caps using (project) where msgs between 2 and cap) where place <= 12),
pairs as (select a.session_id, a.seq, a.project, a.term as term_a, b.term as term_b from top a join top b using (session_id, seq, project) where a.term < b.term),
und as (select project, term_a, term_b, count(*) as weight from pairs group by all),
edges as (select project, term_a, term_b, weight from und union all select project, term_b, term_a, weight from und)"""


def _terms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = t.documents(spark, d)
    return docs, graph.message_terms(docs, "identity", typed=False)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    docs, terms = _terms(spark, d)
    return graph.topic_edges(graph.message_edges(docs, 2, terms=terms))


@query("content_terms", TERMS_SQL + " select session_id, seq, term from terms")
def content_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)[1].select("session_id", "seq", F.explode("stems").alias("term"))


@query("project_df", TERMS_SQL + " select * from pdf")
def project_df(spark: SparkSession, d: str) -> DataFrame:
    return graph.project_df(_terms(spark, d)[1])


@query("hub_caps", TERMS_SQL + " select * from caps")
def hub_caps(spark: SparkSession, d: str) -> DataFrame:
    return graph.hub_caps(t.documents(spark, d), 2)


@query("top12_terms", TERMS_SQL + " select session_id, seq, project, term, place from top")
def top12_terms(spark: SparkSession, d: str) -> DataFrame:
    docs, terms = _terms(spark, d)
    return graph.top_terms(terms, graph.project_df(terms), graph.hub_caps(docs, 2), 2).withColumn("place", F.col("place").cast("long"))


@query("message_pairs", TERMS_SQL + " select * from pairs")
def message_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs, terms = _terms(spark, d)
    return graph.message_pairs(graph.top_terms(terms, graph.project_df(terms), graph.hub_caps(docs, 2), 2))


@query("comention_edges", TERMS_SQL + " select project, term_a, term_b, weight from edges")
def comention_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("project", "term_a", "term_b", "weight")


@query("topic_ids", TERMS_SQL + " select distinct project || chr(31) || term_a as topic_id, project, term_a as term, term_a as label from edges")
def topic_ids(spark: SparkSession, d: str) -> DataFrame:
    docs, terms = _terms(spark, d)
    return graph.topics(graph.topic_edges(graph.message_edges(docs, 2, terms=terms)), graph.labels(terms))


CENTRE = "(select term_a from edges group by term_a order by sum(weight) desc, term_a limit 1)"


def _centre(edges: DataFrame) -> str:
    return edges.groupBy("term_a").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "term_a").limit(1).first()["term_a"]


@query("related_depth1", TERMS_SQL + f" select term_b as term, cast(sum(weight) as bigint) as weight, 'co-mention' as kind from edges where term_a = {CENTRE} group by term_b order by weight desc, term limit 30")
def related_depth1(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d).persist(StorageLevel.MEMORY_AND_DISK)  # for the term in the middle, and what it leads to
    return graph.related(edges, _centre(edges), 1, 30).select("term", "weight", "kind")


@query("related_depth2", TERMS_SQL + f""", one as (select term_b as term, sum(weight) as weight from edges where term_a = {CENTRE} group by 1), via as (select term as via, weight as w1 from one order by weight desc, term limit 8),
hop as (select e2.term_a as via, e2.term_b as term, sum(e2.weight) as w from edges e1 join edges e2 on e2.project = e1.project and e2.term_a = e1.term_b where e1.term_a = {CENTRE} and e2.term_b <> {CENTRE} group by all),
far as (select term, w + w1 as weight, via from hop join via using (via) anti join one using (term)),
best as (select term, max(weight) as weight from far group by term), tied as (select f.term, f.weight, min(f.via) as via from far f join best b on f.term = b.term and f.weight = b.weight group by 1, 2)
select term, cast(weight as bigint) as weight, via from (select term, weight, '' as via from one union all select * from tied) order by weight desc, term, via limit 60""")
def related_depth2(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d).persist(StorageLevel.MEMORY_AND_DISK)
    return graph.related(edges, _centre(edges), 2, 60).select("term", "weight", "via")


@query("graph_expand", TERMS_SQL + f""", c as (select {CENTRE} as term), n as (select e.term_b as term, count(distinct e.term_a) as links, cast(sum(weight) as bigint) as weight, round(sum(weight / greatest(msgs, 1)), 9) as lift
  from edges e join pdf on pdf.project = e.project and pdf.term = e.term_b where e.term_a in (select term from c) and e.term_b not in (select term from c) and weight >= 2 group by 1)
select * from n order by links desc, lift desc, term limit 6""")
def graph_expand(spark: SparkSession, d: str) -> DataFrame:
    docs, terms = _terms(spark, d)
    df = graph.project_df(terms)
    edges = graph.topic_edges(graph.message_edges(docs, 2, df=df, terms=terms)).persist(StorageLevel.MEMORY_AND_DISK)
    return graph.expand(edges, df, [_centre(edges)]).withColumn("lift", F.round("lift", 9))


@query("undo_contribution", TERMS_SQL + " select project, term_a, term_b, count(*) as weight from pairs where session_id not in ('src0', 'src1') group by all")
def undo_contribution(spark: SparkSession, d: str) -> DataFrame:
    """Edges left when two sessions take their part back."""
    docs, terms = _terms(spark, d)
    log = graph.undo(graph.message_edges(docs, 2, terms=terms), ["src0", "src1"])
    return log.groupBy("project", "term_a", "term_b").agg(F.count("*").alias("weight"))


@query("merge_edge_weights", TERMS_SQL + " select project, term_a, term_b, cast(2 * weight as bigint) as weight from edges")
def merge_edge_weights(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return graph.merge_weights(edges, edges).select("project", "term_a", "term_b", "weight")


@query("rename_rewrite", TERMS_SQL + " select case project when 'en' then 'english' else project end || chr(31) || term_a as src_id, case project when 'en' then 'english' else project end || chr(31) || term_b as dst_id, weight from edges")
def rename_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return projects.renamed_edges(_edges(spark, d), "en", "english").select("src_id", "dst_id", "weight")


STORY = [
    ("a", 0, "Atlas replaces Zephyr. The engine's gearbox hums."),
    ("a", 1, "Compass was replaced by Sextant; we keep the old map."),
    ("b", 0, "Use falcon instead of raven! Atlas replaces Zephyr?"),
    ("c", 0, "Nothing here.\nThe barricade's actual shape."),
]


def _story(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STORY, "session_id string, seq int, text string").withColumns({"project": F.lit("p"), "source": F.lit("s"), "role": F.lit("user")})


@query("typed_relations", "select * from (values ('a', 0, 'atlas', 'zephyr', 'replaces', 'Atlas replaces Zephyr'), ('a', 0, 'engine', 'gearbox', 'owns', 'The engine''s gearbox hums'), ('a', 1, 'sextant', 'compass', 'replaces', 'Compass was replaced by Sextant'), ('b', 0, 'falcon', 'raven', 'replaces', 'Use falcon instead of raven'), ('b', 0, 'atlas', 'zephyr', 'replaces', 'Atlas replaces Zephyr')) v(session_id, seq, from_term, to_term, kind, evidence)")
def typed_relations(spark: SparkSession, d: str) -> DataFrame:
    return _story(spark).select("session_id", "seq", F.explode(text.typed_relations("text")).alias("r")).select("session_id", "seq", "r.*")


@query("typed_edges", "select * from (values ('atlas', 'zephyr', 'replaces', 'atlas', 'zephyr', 2::bigint, 'a#0: Atlas replaces Zephyr'), ('engine', 'gearbox', 'owns', 'engine', 'gearbox', 1, 'a#0: The engine''s gearbox hums'), ('compass', 'sextant', 'replaces', 'sextant', 'compass', 1, 'a#1: Compass was replaced by Sextant'), ('falcon', 'raven', 'replaces', 'falcon', 'raven', 1, 'b#0: Use falcon instead of raven')) v(term_a, term_b, kind, from_term, to_term, weight, evidence)")
def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.topic_edges(graph.message_edges(_story(spark), 9, "identity"))
    return edges.where("term_a < term_b").select("term_a", "term_b", "kind", "from_term", "to_term", "weight", "evidence")


IDENTITY_SQL = WITH + """, n as (select *, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\\s+|\\s+$', '', 'g') as body from conv where role <> 'system'),
ids as (select session_id, list(sha256(role || chr(0) || body) order by seq) as hashes, count(*) >= 3 and sum(strlen(body)) >= 500 and bool_or(role = 'user') and bool_or(role = 'assistant' and strlen(body) >= 100) as eligible from n where body <> '' group by session_id)"""


@query("copy_identity", IDENTITY_SQL + " select session_id, array_to_string(hashes, ',') as hashes, eligible from ids")
def copy_identity(spark: SparkSession, d: str) -> DataFrame:
    return copies.identities(t.conversations(spark, d)).select("session_id", F.array_join("hashes", ",").alias("hashes"), "eligible")


def _doubled(spark: SparkSession, d: str) -> DataFrame:
    """Conversations, and every third again under another source, with its last turn missing where it has many."""
    messages = t.conversations(spark, d).withColumn("source", F.lit("x"))
    n = messages.groupBy("session_id").agg(F.max("seq").alias("last"))
    again = messages.join(n, "session_id").where((F.col("session_id").cast("int") % 3 == 0) & ((F.col("last") < 4) | (F.col("seq") < F.col("last"))))
    return messages.unionByName(again.select(F.concat(F.lit("y:"), "session_id").alias("session_id"), *(F.lit("y").alias(c) if c == "source" else F.col(c) for c in messages.columns if c != "session_id")))


def _copies(spark: SparkSession, d: str) -> DataFrame:
    rows = _doubled(spark, d)
    info = rows.groupBy("session_id").agg(F.first("source").alias("source"), F.first("project").alias("project"))
    return copies.identities(rows).join(info, "session_id").withColumn("duplicate_of", F.lit("")).withColumn("seen_at", F.lit(0))


COPY_SQL = WITH.replace("'s' || (conv_id % 3) as source", "'x' as source") + """, l as (select session_id, max(seq) as last from conv group by 1),
both_ as (select * from conv union all select 'y:' || session_id, seq, 'y', project, role, text, created_at from conv join l using (session_id) where cast(session_id as int) % 3 = 0 and (last < 4 or seq < last)),
n as (select *, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\\s+|\\s+$', '', 'g') as body from both_ where role <> 'system'),
ids as (select session_id, any_value(source) as source, any_value(project) as project, list(sha256(role || chr(0) || body) order by seq) as h, count(*) >= 3 and sum(strlen(body)) >= 500 and bool_or(role = 'user') and bool_or(role = 'assistant' and strlen(body) >= 100) as eligible from n where body <> '' group by session_id),
cov as (select a.session_id as copy_id, b.session_id as owner_id from ids a join ids b on a.project = b.project and a.h[1] = b.h[1] where a.session_id <> b.session_id and a.source <> b.source and a.eligible and len(a.h) <= len(b.h) and b.h[1:len(a.h)] = a.h)"""


@query("copy_covered_pairs", COPY_SQL + " select copy_id, owner_id from cov")
def copy_covered_pairs(spark: SparkSession, d: str) -> DataFrame:
    return copies.covered_pairs(_copies(spark, d))


@query("copy_suppression", COPY_SQL + " select copy_id as session_id, min(owner_id) as duplicate_of from cov join ids o on o.session_id = owner_id where o.eligible and starts_with(copy_id, 'y:') and not starts_with(owner_id, 'y:') group by 1")
def copy_suppression(spark: SparkSession, d: str) -> DataFrame:
    return copies.suppress(_copies(spark, d))


@query("copy_canonical", COPY_SQL + " select session_id, case when starts_with(session_id, 'y:') then replace(session_id, 'y:', '') else session_id end as canonical_id from ids")
def copy_canonical(spark: SparkSession, d: str) -> DataFrame:
    rows = _copies(spark, d).withColumn("duplicate_of", F.when(F.startswith("session_id", F.lit("y:")), F.replace(F.col("session_id"), F.lit("y:"), F.lit(""))).otherwise(""))
    return copies.canonical(rows.select("session_id"), rows)


@query("privacy_excluded", WITH + ", f as (select session_id, min_by(case when cast(session_id as int) % 10 = 0 then 'Private: ' || text else text end, seq) as text from conv where role = 'user' group by 1) select session_id, lower(trim(regexp_extract(text, '^\\s*(\\S+)', 1), ',:;.!?\\\"''`#()[]{}<>')) as tag from f where lower(trim(regexp_extract(text, '^\\s*(\\S+)', 1), ',:;.!?\\\"''`#()[]{}<>')) in ('private', 'noingest', 'noduck')")
def privacy_excluded(spark: SparkSession, d: str) -> DataFrame:
    rows = t.conversations(spark, d).withColumn("text", F.when(F.col("session_id").cast("int") % 10 == 0, F.concat(F.lit("Private: "), "text")).otherwise(F.col("text")))
    return copies.exclusion_tags(rows)


@query("privacy_purge", WITH + " select session_id, count(*) as messages from conv where cast(session_id as int) % 10 <> 0 group by 1")
def privacy_purge(spark: SparkSession, d: str) -> DataFrame:
    rows = t.conversations(spark, d)
    marked = rows.where(F.col("session_id").cast("int") % 10 == 0).select("session_id").distinct()
    return copies.without(rows, marked).groupBy("session_id").agg(F.count("*").alias("messages"))


@query("project_stats", WITH + ", s as (select session_id, any_value(project) as project, any_value(source) as source, min(created_at) as started_at from conv group by 1) select project, count(*) as sessions, epoch(min(started_at))::bigint as first_at, epoch(max(started_at))::bigint as last_at, array_to_string(list_sort(list(distinct source)), ',') as sources from s group by project")
def project_stats(spark: SparkSession, d: str) -> DataFrame:
    told = projects.stats(t.sessions(t.conversations(spark, d)))
    return told.select("project", "sessions", F.unix_timestamp("first_at").alias("first_at"), F.unix_timestamp("last_at").alias("last_at"), F.array_join("sources", ",").alias("sources"))


@query("alias_application", WITH + " select case project when 'p0' then 'p2' when 'p1' then 'p2' else project end as project, count(*) as messages from conv group by 1")
def alias_application(spark: SparkSession, d: str) -> DataFrame:
    return projects.apply_aliases(t.conversations(spark, d), {"p0": "p1", "p1": "p2"}).groupBy("project").agg(F.count("*").alias("messages"))


@query("insert_idempotent", WITH + " select session_id, seq, role, text from conv")
def insert_idempotent(spark: SparkSession, d: str) -> DataFrame:
    rows = t.conversations(spark, d)
    stored = rows.where("seq % 2 = 0")
    batch = rows.unionByName(rows)
    return stored.unionByName(reconcile.insert_messages(stored, batch)).select("session_id", "seq", "role", "text")


SYNC_SQL = WITH + """, old as (select session_id, seq, case when cast(session_id as int) % 5 = 0 and seq = 0 then text || '!' else text end as text from conv where cast(session_id as int) % 7 <> 0 and (cast(session_id as int) % 2 = 0 or seq < 2))"""


def _stored(rows: DataFrame) -> DataFrame:
    n = F.col("session_id").cast("int")
    return rows.where((n % 7 != 0) & ((n % 2 == 0) | (F.col("seq") < 2))).withColumn("text", F.when((n % 5 == 0) & (F.col("seq") == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")))


@query("sync_append_vs_rewrite", SYNC_SQL + """, o as (select session_id, list(seq || ':' || text order by seq) as a from old group by 1), c as (select session_id, list(seq || ':' || text order by seq) as b from conv group by 1)
select session_id, case when a is null then 'new' when a = b then 'same' when len(b) > len(a) and b[1:len(a)] = a then 'append' else 'rewrite' end as action from c left join o using (session_id)""")
def sync_append_vs_rewrite(spark: SparkSession, d: str) -> DataFrame:
    rows = t.conversations(spark, d)
    return reconcile.classify_sessions(_stored(rows), rows)


@query("sync_messages", WITH + " select session_id, seq, text from conv")
def sync_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = t.conversations(spark, d)
    return reconcile.sync_messages(_stored(rows), rows)[0].select("session_id", "seq", "text")


@query("upsert_sessions", WITH + """, s as (select session_id, any_value(source) as source, min(created_at) as started_at from conv group by 1)
select session_id, case when cast(session_id as int) % 2 = 0 then 'new' else source end as source, epoch(started_at)::bigint - case when cast(session_id as int) % 3 = 0 then 0 else 100 end as started_at from s""")
def upsert_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = t.sessions(t.conversations(spark, d)).withColumn("updated_at", F.lit(None).cast("timestamp"))
    n = F.col("session_id").cast("int")
    stored = rows.withColumn("started_at", F.when(n % 3 == 0, F.lit(None)).otherwise(F.col("started_at") - F.expr("interval 100 seconds")))
    batch = rows.where((n % 2 == 0) | (n % 3 == 0)).withColumn("source", F.when(n % 2 == 0, "new").otherwise(F.col("source")))
    return reconcile.upsert_sessions(stored, batch).select("session_id", "source", F.unix_timestamp("started_at").alias("started_at"))


@query("table_fingerprint", WITH + " select 'conv' as name, count(*) as n_rows, true as same from conv")
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A table and its compacted copy have equal fingerprints."""
    rows = t.conversations(spark, d)
    a, b = reconcile.fingerprint(rows), reconcile.fingerprint(rows.repartition(3)).withColumnsRenamed({"n_rows": "m", "row_hash": "h"})
    return a.join(b, how="cross").select(F.lit("conv").alias("name"), "n_rows", ((F.col("n_rows") == F.col("m")) & (F.col("row_hash") == F.col("h"))).alias("same"))  # one row each


NAMES = [("celestial", "celeste"), ("martha", "marhta"), ("duckling", "duckpond"), ("dixon", "dicksonx"), ("alpha", "omega"), ("engine", "engines"), ("a", "b")]


@query("jaro_winkler_candidates", "select a, b, round(j + 0.1 * (case when left(a, 4) = left(b, 4) then 4 when left(a, 3) = left(b, 3) then 3 when left(a, 2) = left(b, 2) then 2 when left(a, 1) = left(b, 1) then 1 else 0 end) * (1 - j), 9) as score from (select *, jaro_similarity(a, b) as j from (values " + ", ".join(f"('{a}', '{b}')" for a, b in NAMES) + ") v(a, b))")
def jaro_winkler_candidates(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(NAMES, "a string, b string").select("a", "b", F.round(names.jaro_winkler_column("a", "b"), 9).alias("score"))


REMOTES = [("git@github.com:me/repo.git", "github.com/me/repo"), ("https://GitHub.com/me/repo/", "github.com/me/repo"), ("ssh://git@host:2222/a/b.git", "host:2222/a/b"), ("C:\\\\work\\\\x.git", "C:/work/x")]


@query("canonical_remotes", "select * from (values ('git@github.com:me/repo.git', 'github.com/me/repo'), ('https://GitHub.com/me/repo/', 'github.com/me/repo'), ('ssh://git@host:2222/a/b.git', 'host:2222/a/b'), ('/srv/git/x.git', '/srv/git/x')) v(remote, canonical)")
def canonical_remotes(spark: SparkSession, d: str) -> DataFrame:
    rows = [r[0] for r in REMOTES[:3]] + ["/srv/git/x.git"]
    return spark.createDataFrame([(r,) for r in rows], "remote string").select("remote", names.canonical_remote_column("remote").alias("canonical"))


STEMS = [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("formalize", "formal"), ("electrical", "electr"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("enemies", "enemi"), ("disengaged", "disengag"), ("zephyrturbine", "zephyrturbin")]


@query("porter_stem", "select * from (values " + ", ".join(f"('{w}', '{s}')" for w, s in STEMS) + ") v(word, stem)")
def stemmed(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(w,) for w, _ in STEMS], "word string").select("word", porter_stem("word").alias("stem"))


@query("embed_text")
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    """Hashed embeddings of all messages."""
    return _embedded(t.conversations(spark, d)).select("session_id", "seq", "embedding")


@query("snippets")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return t.conversations(spark, d).select("session_id", "seq", snippet_column(F.col("text"), list(TERMS)).alias("snippet"))


@query("graph_full_rebuild")
def graph_full_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The whole graph with stems, relations and labels."""
    return graph.topic_edges(graph.message_edges(t.documents(spark, d), 2))


from . import log_queries  # noqa: E402, F401  (registers the readers of logs)
