import hashlib
import os
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from logloom.llm import components, embedding_dedup, fingerprints, simhash_dedup, substring_dedup


def roots(n, links):
    forest = components.Forest(n)
    for a, b in links:
        forest.union(a, b)
    return [forest.find(i) for i in range(n)]


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, texts, spark):
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(docs).collect()}
    keys = [k for k, _ in texts]
    want = [plain_fingerprint(t) for _, t in texts]
    assert [got[k].fingerprint for k in keys] == [f"{w:016x}" for w in want]
    links = [(i, j) for i, j in combinations(range(len(keys)), 2) if (want[i] ^ want[j]).bit_count() <= 3]
    root = roots(len(keys), links)
    least = {r: min(keys[i] for i in range(len(keys)) if root[i] == r) for r in set(root)}
    assert [got[k].component_id for k in keys] == [least[r] for r in root]
    assert spark.createDataFrame([(1, "abc"), (2, "ABC")], "doc_id long, text string").transform(simhash_dedup.near_duplicates).select("component_id").distinct().count() == 1


def test_balls_find_every_pair(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(rng.randint(0, 12)):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            prints.add(base ^ flips)
    values = np.array(sorted(prints), np.uint64).view(np.int64)
    frame = spark.createDataFrame([(int(v),) for v in values], "fp long")
    at = {int(v): i for i, v in enumerate(values)}
    found = [(at[r.a], at[r.b]) for r in simhash_dedup.link_fingerprints(frame).collect()]
    close = lambda i, j: bin((int(values[i]) ^ int(values[j])) & (1 << 64) - 1).count("1") <= 3
    assert all(close(i, j) for i, j in found)
    assert roots(len(values), found) == roots(len(values), [(i, j) for i, j in combinations(range(len(values)), 2) if close(i, j)])


def test_spanning_of_crowded_groups(monkeypatch):
    rng = random.Random(5)
    values = np.unique(np.array([sum(1 << b for b in rng.sample(range(14), rng.randint(0, 7))) for _ in range(300)], np.int64))
    full = roots(len(values), simhash_dedup.spanning(values))
    monkeypatch.setattr(simhash_dedup, "SMALL", 1)
    assert roots(len(values), simhash_dedup.spanning(values)) == full


def test_components(spark):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(500, i) for i in range(501, 640)]
    more = [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(200)]
    links = [*chain, *star, *more, (7, 7), *chain[:5]]
    rng.shuffle(links)
    ids = sorted({x for p in links for x in p})
    at = {x: i for i, x in enumerate(ids)}
    root = roots(len(ids), [(at[a], at[b]) for a, b in links])
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(6), "a", "b").collect()}
    assert {x: got.get(x, x) for x in ids} == {x: ids[root[at[x]]] for x in ids}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


WORDS = [f"w{i}" for i in range(4000)]


def test_passages(spark):
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    shared = say(60)
    edited = shared.split()
    edited[30] = "changed"
    hot = [(i, say(20) + " " + shared + " " + say(15)) for i in range(10, 60)]
    rows = [(1, say(300)), (2, say(40) + "\n" + shared + "! " + say(10)), (3, shared.upper()), (4, say(49)), (5, None), (6, ""), (7, "x " * 400), (8, say(5) + " " + say(200)), (100, say(30) + " " + " ".join(edited) + " " + say(30)), *hot]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).toPandas()
    texts = dict(rows)
    plain = lambda t: re.findall(r"\w+", t.lower())
    assert set(found.doc_id) == {3, 100, *(k for k, _ in hot)} and (found.other_id < found.doc_id).all()
    for r in found.itertuples():
        mine = plain(texts[r.doc_id][r.start : r.end])
        assert r.words == len(mine) >= 50
        if r.similarity == 1.0:
            assert mine == plain(texts[r.other_id][r.other_start : r.other_end]) == plain(shared)
        else:
            assert r.doc_id == 100 or r.other_id == 100
    assert set(found[found.doc_id != 100].similarity) == {1.0}


def passages_between(a, b, similarity=0.8):
    x, y = substring_dedup.split([a, b])
    return substring_dedup.common(x[0], x[1], y[0], y[1], 46, similarity)


def likeness_of_words(a, b):
    """Jaccard similarity of five-word shingles, repeats included."""
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    return (x & y).total() / (x | y).total()


def test_passages_lie_on_one_diagonal():
    rng = random.Random(17)
    say = lambda n: rng.choices(WORDS, k=n)
    unit, blocks = say(20), [say(60) for _ in range(4)]
    turned = [blocks[i] for i in (1, 0, 3, 2)]
    cases = [(["x"] * 400, ["x"] * 60), (unit * 10, unit * 3), (sum(blocks, []), sum(turned, [])), (say(24) * 6, say(30))]
    found = []
    for a, b in cases:
        found.append(passages_between(" ".join(a), " ".join(b)))
        for s, n, p, m, like in found[-1]:
            assert 50 <= n <= 60 and like == 1.0 and a[s : s + n] == b[p : p + m]
    assert {i for s, n, *_ in found[0] for i in range(s, s + n)} == set(range(400))
    assert {i for s, n, *_ in found[1] for i in range(s, s + n)} == set(range(200))
    assert [x[:4] for x in found[2]] == [(0, 60, 60, 60), (60, 60, 0, 60), (120, 60, 180, 60), (180, 60, 120, 60)]
    sentence = say(24)
    assert found[3] == [] == passages_between(" ".join(sentence * 6), " ".join(say(40) + sentence + say(40)))


def test_edits_near_the_ends_of_a_passage():
    rng = random.Random(18)
    say = lambda n: rng.choices(WORDS, k=n)
    for at in (1, 2, 3, 4, 25, 45, 46, 47, 48):
        passage = say(50)
        edited = [*passage[:at], "changed", *passage[at + 1 :]]
        found = passages_between(" ".join(say(40) + passage + say(40)), " ".join(say(7) + edited + say(40)))
        assert len(found) == (likeness_of_words(passage, edited) >= 0.8) and all(x[:4] == (40, 50, 7, 50) for x in found)


def test_longest_runs_by_ranks():
    rng = np.random.default_rng(3)
    for size in (2, 3, 50):
        x, y = rng.integers(1, size + 1, 90).astype(np.uint64), rng.integers(1, size + 1, 70).astype(np.uint64)
        length, place = substring_dedup.Ranks(x, y).longest()
        for i in range(len(x)):
            runs = [next((k for k in range(len(x)) if i + k >= len(x) or p + k >= len(y) or x[i + k] != y[p + k])) for p in range(len(y))]
            assert length[i] == max(runs) and (not length[i] or runs[place[i]] == max(runs))


def test_every_row_is_as_alike_as_it_says(docs, texts):
    """All rows, on whole tables, by plain counting."""
    said, plain = dict(texts), lambda t: re.findall(r"\w+", t.lower())
    found = substring_dedup.repeated_passages(docs).collect()
    assert found
    for r in found:
        own, other = plain(said[r.doc_id][r.start : r.end]), plain(said[r.other_id][r.other_start : r.other_end])
        if all(c.isascii() for c in said[r.doc_id] + said[r.other_id]) and "_" not in said[r.doc_id] + said[r.other_id]:
            assert r.words == len(own) >= 50 <= len(other)
            assert abs(likeness_of_words(own, other) - r.similarity) < 1e-9
        assert r.similarity >= 0.8 and r.other_id < r.doc_id
        assert r.passage_md5 == hashlib.md5(said[r.doc_id][r.start : r.end].encode()).hexdigest()


def test_recall_of_edited_passages(spark):
    """Passages with a similarity of 0.8 to 0.9, each in two documents."""
    rng = random.Random(23)
    say = lambda n: rng.choices(WORDS, k=n)
    rows, need = [], []
    while len(need) < 400:
        passage = say(rng.choice((55, 60, 80, 120)))
        edited = list(passage)
        for at in rng.sample(range(5, len(passage) - 5), rng.randint(1, len(passage) // 25)):
            edited[at : at + 1] = rng.choice(([], ["new"], [edited[at], "more"]))
        if 0.8 <= likeness_of_words(passage, edited) <= 0.9 and min(len(passage), len(edited)) >= 50:
            k = 10 * len(need)
            need.append(k + 1)
            rows += [(k, " ".join(say(rng.randint(0, 90)) + passage + say(30))), (k + 1, " ".join(say(rng.randint(0, 90)) + edited + say(30)))]
    found = {(r.doc_id, r.other_id) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum((k, k - 1) in found for k in need)
    assert hit >= 0.9 * len(need) and len(found) == hit


def test_a_repeat_behind_a_common_phrase(spark):
    """Many documents share forty words; a few go on alike. Those are found although the others come first."""
    rng = random.Random(29)
    say = lambda n: rng.choices(WORDS, k=n)
    phrase = say(40)
    rows, need = [(i, " ".join(say(rng.randint(30, 50)) + phrase + say(30))) for i in range(60)], set()
    for i in range(40):
        tail = say(30)
        rows += [(100 + 2 * i + j, " ".join(say(rng.randint(30, 50)) + phrase + tail + say(20))) for j in (0, 1)]
        need.add((101 + 2 * i, 100 + 2 * i))
    rng.shuffle(rows)
    found = {(r.doc_id, r.other_id) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert need <= found


def test_crowded_keys_are_split(spark, monkeypatch):
    """As before, where every key that three documents have is crowded; also where a third of all rows has a passage."""
    monkeypatch.setattr(substring_dedup, "CROWDED", 3)
    test_a_repeat_behind_a_common_phrase(spark)
    rng = random.Random(31)
    say = lambda n: rng.choices(WORDS, k=n)
    shared = say(60)
    rows = [(i, " ".join(say(20) + (shared if i % 3 == 0 else say(60)) + say(20))) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert len(substring_dedup.crowded(frame, 46, "text", "doc_id"))
    found = substring_dedup.repeated_passages(frame).collect()
    assert {r.doc_id for r in found} == set(range(3, 600, 3)) and all(r.words >= 50 and r.similarity == 1.0 for r in found)
    spread = substring_dedup.without_repeats(frame).collect()
    assert sum(" ".join(shared) in r.text for r in spread) == 1


def family(size):
    """Documents with one passage, each edited in its own way; two by two their edits are nearly the same."""
    rng = random.Random(37)
    say = lambda n: rng.choices(WORDS, k=n)
    base, rows = say(56), []
    for i in range(size):
        words = list(base)
        for at in rng.sample(range(56), 3):
            words[at] = f"own{i}"
        other = list(words)
        other[rng.randrange(8, 48)] = f"other{i}"
        rows += [(10 * i, " ".join(say(50) + words + say(50))), (10 * i + 1, " ".join(say(50) + other + say(50)))]
    return rows


@pytest.mark.parametrize(("crowded", "few"), [(32, 8), (3, 8), (3, 1)])
def test_a_crowd_hides_no_edited_passage(spark, monkeypatch, crowded, few):
    """Two documents that have a key in common and are alike there are paired or tied by pairs, however many have that key."""
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    monkeypatch.setattr(substring_dedup, "FEW", few, raising=False)
    monkeypatch.setattr(substring_dedup, "CHUNK", 64, raising=False)
    rows = family(80)
    keys, _, row, *_ = substring_dedup.windows([t for _, t in rows], 46)
    own = [set(keys[row == i].tolist()) for i in range(len(rows))]
    need = [(i, j) for i, j in combinations(range(len(rows)), 2) if own[i] & own[j] and passages_between(rows[j][1], rows[i][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    at = {k: i for i, (k, _) in enumerate(rows)}
    found = [(at[r.other_id], at[r.doc_id]) for r in substring_dedup.repeated_passages(frame).collect()]
    root = roots(len(rows), found)
    assert len(need) > 60 and all(root[i] == root[j] for i, j in need) and {j for _, j in need} <= {j for p in found for j in p}


def test_rows_of_a_crowded_key_are_tied(monkeypatch):
    """Few pairs and many give the same groups, and each row that has an earlier document alike is paired with one."""
    rows = family(30)
    parts, doc = substring_dedup.split([t for _, t in rows]), np.array([k for k, _ in rows])
    alike = [(i, j) for i, j in combinations(range(len(rows)), 2) if substring_dedup.common(*parts[i][:2], *parts[j][:2], 46, 0.8)]
    monkeypatch.setattr(substring_dedup, "EACH", 0)
    made = substring_dedup.tied(parts, doc, np.zeros(len(rows), bool), 46, 0.8).tolist()
    assert roots(len(rows), made) == roots(len(rows), alike) and {max(p) for p in made} == {j for _, j in alike}
    monkeypatch.setattr(substring_dedup, "EACH", 1000)
    assert set(alike) <= {(min(p), max(p)) for p in substring_dedup.tied(parts, doc, np.zeros(len(rows), bool), 46, 0.8).tolist()}


def test_rows_that_are_not_alike_are_not_verified(monkeypatch):
    """Hundreds of texts that repeat a word almost often enough: no row is verified with all others, and none is lost."""
    calls, common = [], substring_dedup.common
    monkeypatch.setattr(substring_dedup, "common", lambda *a: calls.append(1) or common(*a))
    texts = [" ".join([f"a{i}"] * 45 + ["and"] * (40 + i % 10) + [f"b{i}"] * 45) for i in range(200)] + [t for _, t in family(20)]
    parts, doc = substring_dedup.split(texts), np.arange(240)
    alike = [(i, j) for i, j in combinations(range(200, 240), 2) if common(*parts[i][:2], *parts[j][:2], 46, 0.8)]
    made = substring_dedup.tied(parts, doc, np.zeros(240, bool), 46, 0.8).tolist()
    assert roots(240, made) == roots(240, alike) and {max(p) for p in made} >= {j for _, j in alike}
    assert len(calls) < 800


def test_rows_with_few_shingles_in_common_are_not_swept(monkeypatch):
    """Hundreds of texts share a phrase that is too short to be a passage: a row's sweep does not go over all others."""
    rng = random.Random(41)
    say = lambda n: rng.choices(WORDS, k=n)
    phrase, swept, sweep = say(14), [], substring_dedup.Unit._of_others
    monkeypatch.setattr(substring_dedup.Unit, "_of_others", lambda self, *a: swept.append(max(len(x) for x in a if isinstance(x, np.ndarray))) or sweep(self, *a))
    texts = [" ".join(say(40) + phrase + say(40)) for _ in range(200)] + [t for _, t in family(20)]
    parts, doc = substring_dedup.split(texts), np.arange(240)
    alike = [(i, j) for i, j in combinations(range(200, 240), 2) if substring_dedup.common(*parts[i][:2], *parts[j][:2], 46, 0.8)]
    made = substring_dedup.tied(parts, doc, np.zeros(240, bool), 46, 0.8).tolist()
    assert roots(240, made) == roots(240, alike) and {max(p) for p in made} >= {j for _, j in alike}
    assert sum(swept) < 20 * sum(len(p[0]) for p in parts)


def test_shingles_that_rows_share():
    """As many as two multisets have in common, and whatever has a passage in common has enough."""
    rng = random.Random(43)
    texts = [" ".join(rng.choices("ab", k=rng.randint(0, 90))) for _ in range(60)] + ["", "a b c", " ".join(["a"] * 80)]
    texts += [t for _, t in family(10)] + [" ".join(rng.choices(WORDS, k=60)) for _ in range(5)]
    parts = substring_dedup.split(texts)
    unit, count = substring_dedup.Unit(parts, 46, 0.8), [Counter(p[0].tolist()) for p in parts]
    for x, y in combinations(range(len(parts)), 2):
        assert unit.shared(x)[y] == unit.shared(y)[x] == (count[x] & count[y]).total()
        if substring_dedup.common(*parts[x][:2], *parts[y][:2], 46, 0.8):
            assert unit.shared(x)[y] >= unit.need and x in unit.hopes(y, np.ones(len(parts), bool))


def test_exact_windows_are_linked_to_the_first():
    rng = random.Random(47)
    rows = [np.array(rng.choices(range(1, 3), k=rng.randint(0, 12)), np.uint64) for _ in range(80)]
    doc = np.array(rng.choices(range(40), k=80))
    need, least = set(), {}
    for i in sorted(range(80), key=lambda i: (doc[i], i)):
        for at in range(len(rows[i]) - 5):
            first = least.setdefault(tuple(rows[i][at : at + 6].tolist()), i)
            if doc[first] != doc[i]:
                need.add((i, first))
    assert need and set(map(tuple, substring_dedup.firsts(rows, doc, 6).tolist())) == need


def test_recent_windows():
    recent = substring_dedup.Recent()
    a = lambda *v: np.array(v, np.int64)
    w = lambda *v: np.array(v, np.uint64)
    assert not recent.meet(w(1, 5), a(7, 8), a(70, 80))[0].any()
    had, doc, span = recent.meet(w(1, 3, 5), a(9, 1, 2), a(90, 10, 20))
    assert had.tolist() == [True, False, False] and doc.tolist() == [7] and span.tolist() == [70]  # 2 is less than 8
    had, doc, _ = recent.meet(w(3, 5), a(4, 4), a(0, 0))
    assert had.all() and doc.tolist() == [1, 2]


def test_passages_are_cut_once(spark):
    rng = random.Random(13)
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    shared = say(80)
    rows = [(1, "a " + shared + " b", 5), (2, "c " + shared + " d é", 6), (3, "clean", 7), (4, None, 8), (5, shared, 9)]
    kept = {r.doc_id: r for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, start int")).collect()}
    assert kept[1].text == rows[0][1] and kept[3].text == "clean" and kept[4].text is None
    assert kept[2].text == "c  d é" and kept[5].text == "" and kept[2].start == 6


def test_exact_passages_are_all_found(docs, texts):
    seen, need = {}, set()
    for k, t in sorted((k, t or "") for k, t in texts):
        token, *_ = substring_dedup.shingles([t])
        token = token[: max(0, len(token) - 4)]
        own = {token[i : i + 46].tobytes() for i in range(len(token) - 45)}
        if any(w in seen for w in own):
            need.add(k)
        seen |= dict.fromkeys(own, k)
    got = {r.doc_id for r in substring_dedup.repeated_passages(docs).select("doc_id").distinct().collect()}
    assert need <= got


def test_sliding_minima():
    x = np.random.default_rng(1).integers(1, 1000, 137).astype(np.uint64)
    for w in (1, 2, 46, 137):
        assert substring_dedup.sliding_minima(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def test_sliding_minima_are_the_wide_nodes_of_the_cartesian_tree():
    """A node's subtree spans what lies between the next smaller values on both sides."""
    values = np.random.default_rng(4).permutation(500).astype(np.uint64)
    for w in (3, 46):
        span = {}
        for c, v in enumerate(values):
            left = next((i for i in range(c - 1, -1, -1) if values[i] < v), -1)
            right = next((i for i in range(c + 1, len(values)) if values[i] < v), len(values))
            span[c] = right - left - 1
        minima = {int(np.flatnonzero(values == m)[0]) for m in substring_dedup.sliding_minima(values, w)}
        assert minima == {c for c, n in span.items() if n >= w}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    out = []
    for i in range(40):
        base = rng.normal(size=24)
        for j in range(rng.integers(1, 9)):
            out.append((base + rng.normal(size=24) * (0.02 + 0.1 * (j % 4)), int(i % 3)))
    rows = [(k, [float(x) for x in v], label) for k, (v, label) in enumerate(out)]
    n = len(rows)
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, [2 * x for x in rows[0][1]], rows[0][2]), (n + 2, None, 0), (n + 3, [0.0] * 24, 0), (n + 4, [float("nan")] * 24, 0), (n + 5, [float("inf")] + [1.0] * 23, 0), (n + 6, rows[0][1], None), (n + 7, [None, *rows[0][1][1:]], 0), (n + 8, [1.0, 2.0], 0), (n + 9, [2.0, 4.0], 0), (n + 10, [], 0), (n + 11, [1e200, 1e200], 0), (n + 12, [1e-200, 1e-200], 0)]
    return rows


def test_embeddings(spark, vectors):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v) / np.abs(v).max()
        return a / np.linalg.norm(a)

    units = [unit(v) for _, v, _ in vectors]
    links = [(i, j) for i, j in combinations(range(len(vectors)), 2) if units[i] is not None and units[j] is not None and vectors[i][2] is not None and vectors[i][2] == vectors[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93]
    root = roots(len(vectors), links)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(vectors)
    found = sum(got[i].n_links for i in range(len(vectors)))
    assert 0.9 * 2 * len(links) <= found <= 2 * len(links)
    assert [got[i].n_links for i in range(len(vectors))] == [sum(i in p for p in links) for i in range(len(vectors))]
    assert [got[i].component_id for i in range(len(vectors))] == root
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_recall(spark, data):
    """On the tables themselves, against all pairs."""
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = table.toPandas().sort_values("vec_id")
    x = np.stack(rows.embedding.values).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = rows.label.values[:, None] == rows.label.values[None]
    near = (x @ x.T >= 0.93) & same & ~np.eye(len(x), dtype=bool)
    got = embedding_dedup.near_duplicates(table).toPandas().sort_values("vec_id")
    assert (got.n_links.values <= near.sum(axis=1)).all() and got.n_links.sum() >= 0.9 * near.sum()


def test_embeddings_of_few_dimensions(spark):
    """Neighbours differ along the axes that lists are cut by; every link counts at both ends."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 5)) @ rng.normal(size=(5, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93).sum(axis=1) - 1
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(table).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == near.tolist()


def test_embeddings_in_blocks_and_passes(spark, vectors, monkeypatch):
    """Every label in several blocks, few units in a pass, crowded blocks too; results as before."""
    for name, size in (("BLOCK", 4), ("BLOCKS", 64), ("PASS_BYTES", 1)):
        monkeypatch.setattr(embedding_dedup, name, size)
    test_embeddings(spark, vectors)
    rng = np.random.default_rng(14)
    x = rng.normal(size=64)[None] + rng.normal(size=(500, 64)) * 0.27
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert 0.1 < near.mean() / 500 < 0.9
    table = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = embedding_dedup.near_duplicates(table).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == near.tolist()


def test_embeddings_need_little_disk(spark, monkeypatch):
    """What is written, and what a pass sends, for vectors that probe most lists."""
    rng = np.random.default_rng(15)
    x = rng.normal(size=(20_000, 64)).astype(np.float32)
    x[10_000:] = x[:10_000] + rng.normal(size=(10_000, 64)) * 0.1
    written, kept = [], embedding_dedup.saved

    def noted(df, name):
        out = kept(df, name)
        written.append(sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(embedding_dedup, "saved", noted)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": list(x), "label": [i % 3 // 2 for i in range(10_000)] * 2}), "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_duplicates(table).toPandas()
    assert got.n_links.sum() == 20_000 and got.kept.sum() == 10_000
    assert sum(written) < 1.5 * x.nbytes


def test_embeddings_of_more_widths_than_indexes(spark, vectors, monkeypatch):
    """Also with further columns whose names are used within."""
    monkeypatch.setattr(embedding_dedup, "WIDTHS", 1)
    rows = [(w * 10 + i, [1.0 + 0.001 * i] * (w - 1) + [2.0], 0, "x", 1) for w in range(2, 9) for i in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v string, rep int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    assert all(got[w * 10 + i].n_links == 2 and got[w * 10 + i].component_id == w * 10 for w in range(2, 9) for i in range(3))
    test_embeddings(spark, vectors)


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in fingerprints.compare(docs, per_bucket=16).collect()}
    ordered = sorted(texts)
    import hashlib

    for (k, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, after = t or "", after or ""
        cut = len(t) // 4
        other = t[: len(t) - cut] + after[:cut]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(other.encode()).hexdigest())
        (own, changed, following) = (fingerprints.sketches([x])[0] for x in (t, other, after))
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.shown(own), fingerprints.shown(changed))
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(own, changed), fingerprints.likeness(own, following))
    long = [r for r in got.values() if r.n_chars > 400 and r.doc_id >= 0]
    assert np.mean([r.near_edited for r in long]) > 0.45 and np.mean([r.near_next for r in long]) < 0.05


def test_parsing_is_local():
    rng = random.Random(2)
    say = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    inner = say(3000)
    a, b = fingerprints.sketches([say(17) + inner + say(40), say(230) + inner])
    assert fingerprints.likeness(a, b) > 0.7
    assert fingerprints.likeness(a, fingerprints.sketches([say(3000)])[0]) < 0.1
    for odd in ("", "a", "aa", "ab", "aaaaaaa" * 50, "ab" * 300):
        assert fingerprints.sketches([odd, "x", odd])[0][0] == fingerprints.sketches([odd])[0][0]


def test_labels_differ_from_neighbours():
    rng = np.random.default_rng(1)
    names = rng.integers(0, 2**63, 5000).astype(np.uint64)
    names = names[np.append(True, names[1:] != names[:-1])]
    made = fingerprints.labels(names, np.array([0]))
    assert made.max() < 6 and (made[2:] != made[1:-1]).all()


def test_empty_tables(spark, nothing):
    assert simhash_dedup.near_duplicates(nothing).count() == 0
    assert substring_dedup.repeated_passages(nothing).count() == 0
    assert substring_dedup.without_repeats(nothing).count() == 0
    assert fingerprints.compare(nothing).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_null_keys_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash_dedup.near_duplicates(rows).collect()) == [(0, 0), (0, 3), (3, 3), (3, 3)]
    assert fingerprints.compare(rows).count() == 4
    assert substring_dedup.repeated_passages(rows).count() == 0
    assert substring_dedup.without_repeats(rows).where(F.col("text").isNotNull()).count() == 3
