import hashlib
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logloom.llm import bpe_codec, packing, token_counts

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = st.text(st.sampled_from(list("aAbB'st  \n\t.,!’▁éÉßΣσς漢字😀٣½…“”<|>s/́ \x1c\x85İ")) | st.characters(exclude_categories=["Cs"]), max_size=60)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def test_counts(docs, texts, pieces):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, PIECES, 4096).collect()}
    for k, t in texts:
        t = t or ""
        n = len(pieces.encode(t))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len(t.encode()), n, n > 4096)


def test_encode_and_decode(docs, texts, library):
    got = {r.doc_id: r for r in bpe_codec.encode_decode(docs, WORDS, with_ids=True).collect()}
    for k, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[k].ids == ids and got[k].decoded == back and got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(rows=st.lists(ODD, min_size=1, max_size=6))
def test_any_text(rows, pieces, library):
    assert token_counts.counter(PIECES).count(rows).tolist() == [len(x) for x in pieces.encode(rows)]
    assert bpe_codec.encode_texts(WORDS, rows) == [library.encode(x, add_special_tokens=False).ids for x in rows]


def test_marks_that_editions_of_unicode_order_differently(library):
    marks = [chr(i) for i in np.flatnonzero(bpe_codec.moved())]
    rows = [x for c in marks for x in (f"a{c}\u0334b", f"\u0315{c}", unicodedata.normalize("NFD", c), f"x {c}\u0301é Σ")]
    assert len(marks) > 50
    assert bpe_codec.encode_texts(WORDS, rows) == [library.encode(x, add_special_tokens=False).ids for x in rows]


@settings(max_examples=200, deadline=None)
@given(rows=st.lists(ODD, min_size=1, max_size=6))
def test_ids_of_words_asked_for_together(rows, library):
    got = bpe_codec.codec(WORDS).per_row(rows, packing.ids_memo(WORDS), lambda i: i.to_bytes(4, "little"))
    assert [np.frombuffer(b"".join(x), "<u4").tolist() for x in got] == [library.encode(x, add_special_tokens=False).ids for x in rows]


def ids_of(memo, rows):
    return [np.frombuffer(x, "<u4").tolist() for x in packing.encoded(bpe_codec.codec(WORDS), memo, rows)]


def test_words_seen_before_are_not_asked_for_again(monkeypatch):
    asked = []
    real = packing.WordIds.ask
    monkeypatch.setattr(packing.WordIds, "ask", lambda self, words: asked.append(len(words)) or real(self, words))
    letters = np.array(list("abcdefghij"))
    rows = [" ".join("".join(letters[[int(d) for d in str(k)]]) for k in range(at, at + 8000)) for at in range(0, 320_000, 8000)]
    memo = packing.WordIds(WORDS)
    first = ids_of(memo, rows)
    assert sum(asked) == 320_000 and ids_of(memo, rows) == first and sum(asked) == 320_000


@settings(max_examples=30, deadline=None)
@given(rows=st.lists(ODD, min_size=1, max_size=6), long=st.integers(60, 70))
def test_remembered_words_in_small_tables(rows, long, library):
    rows = [*rows, "a" * long + " b <|endoftext|>" + "é" * 200, "", "<|startoftext|>", "漢" * long + " 'sb"]
    memo = packing.WordIds(WORDS, 5)
    for part in ([*rows, *rows], rows[::-1], rows):
        assert ids_of(memo, part) == [library.encode(x, add_special_tokens=False).ids for x in part]


def test_table_drops_the_words_used_longest_ago(library):
    memo, rows = packing.WordIds(WORDS, 2000), [" ".join(f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for b in range(26) for c in range(26)) for a in range(26)]
    for row in [*rows, *rows[::-1]]:
        assert ids_of(memo, [row]) == [library.encode(row, add_special_tokens=False).ids] and memo.n <= 2000 + 676
    memo.trim()
    assert memo.n <= 1000 and ids_of(memo, rows) == [library.encode(x, add_special_tokens=False).ids for x in rows]


def test_hashes_that_meet_in_the_table():
    memo = packing.WordIds(WORDS)
    k = np.arange(600, dtype=np.uint64)
    h = np.uint64(65534) + k % np.uint64(3) + (k << np.uint64(40))
    for at in range(0, 600, 200):
        memo.insert(h[at : at + 200], np.arange(at, at + 200), 1, 0)
    assert (memo.keys[memo.find(h)] == h).all() and (memo.start[memo.find(h)] == np.arange(600)).all()


def test_words_that_the_library_splits_are_asked_for_alone(library):
    words = ["a b", "c", "longer words", "x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.ids_memo(WORDS).many(words)] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_long_units(pieces, library):
    for t in ("a" * 4000, "ab" * 3000, " " * 999, "'" * 99, "don't we'll 'sup ''s x's's"):
        assert token_counts.counter(PIECES).count([t])[0] == len(pieces.encode(t))
        assert bpe_codec.encode_texts(WORDS, [t])[0] == library.encode(t, add_special_tokens=False).ids


def test_packing(docs, texts, library):
    rows = packing.pack(docs, WORDS, 4096, 2).toPandas()
    ids = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in texts}
    assert rows.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids.items()}
    for r in rows.itertuples():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(piece.tobytes())
    for _, one in rows.sort_values("start").groupby("doc_id"):
        assert (one.start.values[1:] == (one.start + one.length).values[:-1]).all() and one.start.values[0] == 0
    for _, one in rows.sort_values("offset").groupby("sequence_id"):
        assert (one.offset.values == np.append(0, np.cumsum(one.length.values)[:-1])).all()
        total = int(one.length.sum())
        assert total <= 4096 and (total == 4096 or total & (total - 1) == 0)


@settings(max_examples=100, deadline=None)
@given(lengths=st.lists(st.integers(1, 300), max_size=60), capacity=st.sampled_from([1, 2, 8, 64]))
def test_packer_keeps_every_id_once(lengths, capacity):
    p = packing.HarmonicPacker(capacity, 4)
    for k, n in enumerate(lengths):
        p.add(k, np.arange(n, dtype="<u4").tobytes())
    p.finish()
    got = sorted((k, start, n) for k, start, n, *_ in p.rows)
    at = {k: 0 for k in range(len(lengths))}
    for k, start, n in got:
        assert start == at[k]
        at[k] += n
    assert at == dict(enumerate(lengths))
    total: dict[int, int] = {}
    for _, _, n, _, _, s, offset in p.rows:
        assert offset == total.get(s, 0)
        total[s] = offset + n
    assert all(t <= capacity and t & (t - 1) == 0 for t in total.values())


def test_empty_tables(nothing):
    assert token_counts.count_tokens(nothing, PIECES, 4096).count() == 0
    assert bpe_codec.encode_decode(nothing, WORDS).count() == 0
    assert packing.pack(nothing, WORDS, 4096, 2).count() == 0
