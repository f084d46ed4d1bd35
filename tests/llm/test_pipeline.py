import random

import corpus_pipeline
from logloom.llm import components, simhash_dedup
from logloom.llm.queries import QUERIES

CONTRACT = {
    "op2_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op3_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op4_bpe_codec": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_simhash_dedup": {"doc_id", "fingerprint", "component_id"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op8_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op9_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op10_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
}


def test_contracts(spark, data):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    for name, columns in CONTRACT.items():
        assert columns <= set(QUERIES[name](spark, data).columns)


def test_stages_keep_their_promises(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, data).cache()
        assert docs.columns == columns and [f.dataType for f in docs.schema] == [f.dataType for f in before.schema], name
        assert docs.join(before, "doc_id", "left_anti").count() == 0 and 0 < docs.count() <= before.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_copies_go_and_clean_documents_stay(spark, data):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choices([f"k{i}" for i in range(3000)], k=n))
    base, passage = say(200), say(70)
    rows = [(1, base), (2, base), (3, base + " "), (4, say(80) + " " + passage), (5, say(90) + " " + passage), (6, say(120))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.simhash_stage(spark, docs, data)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]
    cut = {r.doc_id: r for r in corpus_pipeline.substring_stage(spark, kept, data).collect()}
    assert cut[4].text == rows[3][1] and cut[6].text == rows[5][1] and passage not in cut[5].text
    assert cut[5].n_chars == len(cut[5].text) and len(cut[5].text) == len(rows[4][1]) - len(passage)


def test_near_copies_go_by_their_similarity(spark, data):
    """Five-word Jaccard 0.8 and more goes, less stays."""
    rng = random.Random(21)
    rows, gone = [], set()

    def shingles(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    for i in range(40):
        base = rng.choices([f"k{j}" for j in range(3000)], k=200)
        rows.append((10 * i, " ".join(base)))
        for n in (1, 2, 4, 8):
            words = list(base)
            for at in rng.sample(range(200), n):
                words[at] = "changed"
            rows.append((10 * i + n, " ".join(words)))
            a, b = shingles(base), shingles(words)
            if len(a & b) / len(a | b) >= 0.8:
                gone.add(10 * i + n)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, data).select("doc_id").collect()}
    assert len(gone) > 80 and kept == {k for k, _ in rows} - gone


def test_no_near_copy_is_left_out_of_a_large_group(spark, data, monkeypatch):
    """Groups as with all pairs, although the first step, which looks at a key's neighbours only, finds nothing."""
    monkeypatch.setattr(simhash_dedup, "alike", lambda batches: (b.select([0, 1]).rename_columns(["a", "b"]).slice(0, 0) for b in batches))
    monkeypatch.setattr(simhash_dedup, "VERIFIED", 0)
    monkeypatch.setattr(simhash_dedup, "CHUNK", 16, raising=False)
    rng = random.Random(41)
    base = rng.choices([f"k{j}" for j in range(3000)], k=150)
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(150), 3):
            words[at] = f"own{i}"
        twin = list(words)
        twin[rng.randrange(150)] = f"twin{i}"
        texts += [words, twin]
    parts = [{tuple(w[k : k + 5]) for k in range(146)} for w in texts]
    forest = components.Forest(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if len(parts[i] & parts[j]) / len(parts[i] | parts[j]) >= 0.8:
                forest.union(i, j)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_copies(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [forest.find(i) for i in range(len(texts))]


def test_pairs_that_are_not_alike_make_no_rows(spark, monkeypatch):
    """In a large group of texts of which each is near the others, but none near enough."""
    made = []

    def noted(df, name, saved=simhash_dedup.saved):
        made.append(saved(df, name))
        return made[-1]

    monkeypatch.setattr(simhash_dedup, "saved", noted)
    rng = random.Random(43)
    base, rows = rng.choices([f"k{j}" for j in range(3000)], k=600), []
    for i in range(80):
        words = list(base)
        for at in rng.sample(range(600), 11):
            words[at] = f"own{i}"
        rows.append((i, " ".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").transform(simhash_dedup.near_copies)
    assert made[-2].count() > 80 and made[-1].count() <= 80


def odd_rows():
    """Repeated rows, a key with two texts, null and empty texts, null keys, and columns with names used within."""
    rng = random.Random(33)
    say = lambda n: " ".join(rng.choices([f"k{i}" for i in range(3000)], k=n))
    a, b, c = say(120), say(130), say(90)
    return [(1, a), (1, a), (5, a), (5, b), (7, None), (8, ""), (None, c), (None, c), (9, "  "), (10, " ".join([a.upper(), "x"])), (None, a)], (a, b, c)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "m", 4, "w") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string, node int, words string")


def test_stages_on_odd_rows(spark, data):
    rows, (a, b, c) = odd_rows()
    docs = frame(spark, rows)
    assert corpus_pipeline.toxicity_stage(spark, docs, data).count() == len(rows)
    kept = corpus_pipeline.simhash_stage(spark, docs, data)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, a), (5, b), (7, ""), (0, c)])
    cut = corpus_pipeline.substring_stage(spark, docs, data).collect()
    assert len(cut) == len(rows)
    assert sorted(r.text for r in cut if r.doc_id in (1, 5)) == sorted([a, a, "", b]) and all(r.text == c for r in cut if r.doc_id is None and r.text != a)
    assert all(r.n_chars == len(r.text or "") for r in cut)
    pieces = corpus_pipeline.packing_stage(spark, docs, data).collect()
    assert sum(r.start == 0 for r in pieces) == len(rows)
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_stages_on_an_empty_table(spark, data):
    docs = frame(spark, odd_rows()[0]).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_whole_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0
