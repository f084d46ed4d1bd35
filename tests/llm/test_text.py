import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from logloom.llm import license_scan, toxicity
from logloom.llm.textnum import Memo, distinct, prefix_hash, runs, span_hash


def test_spans():
    data = np.frombuffer(b"ab cab  ab", np.uint8)
    starts, ends = runs(data != 32, np.array([0, 4, len(data)]))
    assert [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] == [b"ab", b"c", b"ab", b"ab"]
    keys = span_hash(prefix_hash(data), starts, ends)
    assert keys[0] == keys[2] == keys[3] != keys[1]
    index, inverse = distinct(keys)
    assert (keys[index][inverse] == keys).all()


def test_memo_forgets_and_stays_right():
    m = Memo(lambda ks: [k * 2 for k in ks], 3)
    for k in [1, 2, 3, 4, 5, 1, 2, 9, 9, 1]:
        assert m.many([k, k + 1]) == [2 * k, 2 * k + 2]


def test_toxicity_on_held_out_rows(spark):
    """Marked words and marked beginnings in made-up prose, in two languages."""
    rng = random.Random(1)
    syllables = {"a": ["the", "an", "er", "on", "ing", "ed", "or", "ti"], "b": ["der", "ein", "ich", "ung", "ver", "keit", "zu", "ö"]}
    insults = {"a": lambda: rng.choice(["grumpkin", "snarlbag"]), "b": lambda: "zwolf" + rng.choice(syllables["b"]) + rng.choice(syllables["b"])}
    rows, labels = [], []
    for i in range(1500):
        lang = rng.choice("ab")
        words = ["".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(15, 200))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(2 + len(words) // 50):
                words.insert(rng.randint(0, len(words)), insults[lang]())
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    rows += [(9001, None, ""), (9002, "", ""), (9003, "!" * 3000, "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.classify(docs, marks).toPandas().set_index("doc_id")
    assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    y = dict(labels)
    held = [i for i in got.index if got.held_out[i] and i in y]
    hit = sum(got.predicted[i] and y[i] for i in held)
    assert hit >= 0.85 * sum(y[i] for i in held) and sum(got.predicted[i] and not y[i] for i in held) <= 0.02 * len(held)
    assert not got.predicted[[9001, 9002, 9003]].any()
    import zlib

    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got.index)
    assert toxicity.classify(docs, marks.where("false")).where("predicted = 1").count() == 0
    assert toxicity.classify(docs.where("false"), marks).count() == 0


def plain_kneser_ney(docs):
    """Log-likelihood of a word under each class, by dictionaries and recursion as in a textbook."""
    ends = lambda w: [w[:k] for k in toxicity.LEVELS if len(w) > k] + [w + b"$"]
    count = {0: Counter(), 1: Counter()}
    follow = {}
    for text, y in docs:
        pairs = {(a, b) for w in text.encode().split() for a, b in zip([b"", *ends(w)], ends(w), strict=False)}
        count[y].update(pairs)
        for a, b in pairs:
            follow.setdefault(a, set()).add(b)
    d = toxicity.DISCOUNT
    contexts = lambda a, b: sum((a, b) in count[c] for c in (0, 1))

    def shared(a, b):
        total = sum(contexts(a, x) for x in follow[a])
        return max(contexts(a, b) - d, 0) / total + d * len(follow[a]) / total / len(follow[a])

    def probability(a, b, y):
        total, kinds = sum(count[y][a, x] for x in follow[a]), sum((a, x) in count[y] for x in follow[a])
        if not total:
            return shared(a, b)
        return max(count[y][a, b] - d, 0) / total + d * kinds / total * shared(a, b)

    return lambda w, y: sum(math.log(probability(a, b, y)) for a, b in zip([b"", *ends(w.encode())], ends(w.encode()), strict=False))


def test_log_likelihoods_are_those_of_plain_kneser_ney():
    rng = random.Random(6)
    syllables = ["ab", "be", "cor", "da", "el", "fin"]
    docs = [(" ".join("".join(rng.choices(syllables, k=rng.randint(1, 5))) for _ in range(rng.randint(3, 30))), int(rng.random() < 0.4)) for _ in range(60)]
    plain = plain_kneser_ney(docs)
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in docs]), pa.array([y for _, y in docs]), pa.array([i % 2 for i in range(len(docs))])], ["text", "y", "fold"])
    table = pa.Table.from_batches(list(toxicity.count_batches(iter([batch]))))
    frame = table.to_pandas().groupby(["key", "parent", "level"], as_index=False).sum()
    found = toxicity.evidence({c: frame[c].to_numpy() for c in frame}, "01", caution=0.0)
    words = sorted({w for t, _ in docs for w in t.split()})
    got, number = found.sums(words)
    assert (number == 1).all() and np.allclose(got, [plain(w, 1) - plain(w, 0) for w in words], atol=1e-5)
    cautious = toxicity.evidence({c: frame[c].to_numpy() for c in frame}, "01").sums(words)[0]
    assert (np.abs(cautious) <= np.abs(got).max()).all() and np.abs(cautious).sum() < np.abs(got).sum()


def test_toxicity_of_repeated_rows_and_very_long_texts(spark):
    rng = random.Random(8)
    filler = lambda: " ".join(rng.choices([f"w{k}" for k in range(400)], k=30))
    rows = [(i, filler() + (" snarl bark" if i % 3 == 0 else " calm words"), 1) for i in range(400)]
    rows += [(5, rows[5][1], 1), (5, "other text of a repeated key", 1), (None, "snarl bark snarl", 1), (900, "calm words here " * 100_000, 1), (901, "snarl bark now " * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out int")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(None, 1), (7, None), (0, 0)], "doc_id long, toxic int")
    got = toxicity.classify(docs, marks).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 5 for r in got) == 3 and not any(r.held_out for r in got if r.doc_id is None)
    score = {r.doc_id: r.score for r in got}
    assert score[901] > score[900] and len({r.score for r in got if r.doc_id == 5}) == 2


def test_held_out_labels_are_not_learnt(spark):
    rows = [(i, f"word{i % 7} text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    turned = marks.select("doc_id", (toxicity.held_out(marks["doc_id"]).cast("int") * (1 - marks["toxic"]) + (1 - toxicity.held_out(marks["doc_id"]).cast("int")) * marks["toxic"]).cast("int").alias("toxic"))
    a, b = (toxicity.classify(docs, m).toPandas().sort_values("doc_id").score.values for m in (marks, turned))
    assert np.allclose(a, b)


def test_licenses(spark, data):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choices([f"v{i}" for i in range(500)], k=n))
    rows, want = [], set()
    for i, (name, body) in enumerate(license_scan.TEMPLATES.items()):
        rows.append((i, f"{say(30)} é {body} {say(20)}"))
        want.add((i, name))
        rows.append((100 + i, " ".join(body.split()[: len(body.split()) // 2])))
    words = license_scan.TEMPLATES["MIT"].split()
    for k in range(0, len(words), 15):
        words[k] = "changed"
    rows += [(50, " ".join(words)), (60, None), (61, ""), (62, say(2000)), (63, "Released under the MIT License. " * 3)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert want <= {(r.doc_id, r.license) for r in got} and {r.license for r in got if r.doc_id == 50} == {"MIT"}
    assert sum(r.doc_id == 63 for r in got) == 3 and not any(r.doc_id in (60, 61, 62) for r in got)
    for r in got:
        text = dict(rows)[r.doc_id][r.start : r.end]
        if r.coverage == 1.0:
            assert re.findall(r"\w+", text) == re.findall(r"\w+", license_scan.TEMPLATES[r.license])
    notices = {"CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.", "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.", "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.", "MIT-notice": "Released under the MIT License."}
    counts = {n: duckdb.connect().sql(f"select coalesce(sum((length(text) - length(replace(text, '{s}', ''))) // {len(s)}), 0)::int from '{data}/documents.parquet'").fetchall()[0][0] for n, s in notices.items()}
    found = license_scan.scan(spark.read.parquet(f"{data}/documents.parquet")).groupBy("license").count().collect()
    assert {r.license: r["count"] for r in found if r.license in notices} == {k: v for k, v in counts.items() if v}
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_texts_are_whole(spark):
    """A prefix is no license, and a license is not another that begins like it."""
    bodies = license_scan.TEMPLATES
    two, three = bodies["BSD-2-Clause"], bodies["BSD-3-Clause"]
    rows = [(1, three), (2, two), (3, two[: two.index("THIS SOFTWARE")]), (4, bodies["GPL-2.0"]), (5, bodies["Apache-2.0"]), (6, bodies["GPL-3.0"])]
    got = {(r.doc_id, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "BSD-3-Clause"), (2, "BSD-2-Clause"), (4, "GPL-2.0"), (5, "Apache-2.0"), (6, "GPL-3.0")}
