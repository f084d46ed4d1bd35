import numpy as np
import pytest

from logloom.functions import names, porter, snippets, text, vectors


@pytest.mark.parametrize(
    "word, stem",
    [("caresses", "caress"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("bled", "bled"), ("sing", "sing"), ("sized", "size"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("sky", "sky"), ("conditional", "condit"), ("digitizer", "digit"), ("operator", "oper"), ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"), ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"), ("allowance", "allow"), ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt"), ("effective", "effect"), ("rate", "rate"), ("cease", "ceas"), ("roll", "roll"), ("enemy", "enemi"), ("disengage", "disengag"), ("è", "è"), ("x2", "x2")],
)
def test_porter(word, stem):
    assert porter.stem(word) == stem


def test_word_lists():
    assert len(set(text.STOPWORDS)) == 235 and len(set(text.WEAK_ENDPOINTS)) == 65


def test_relations():
    found = {r[:3] for r in text.relations("The engine's gearbox broke. Falcon replaces raven! Compass was superseded by sextant. Use atlas instead of globe; barricade's actual shape.")}
    assert found == {("engine", "gearbox", "owns"), ("falcon", "raven", "replaces"), ("sextant", "compass", "replaces"), ("atlas", "globe", "replaces")}


def test_embedding():
    v = np.array(vectors.embed(["alpha", "beta", "alpha", "beta"]))
    assert len(v) == 384 and abs((v**2).sum() - 1) < 1e-6
    assert vectors.embed([]) is None
    assert v @ np.array(vectors.embed(["alpha", "beta"])) > 0.8


def test_snippet():
    body = "filler " * 60 + "the enemies disengaged quickly " + "filler " * 60
    got = snippets.snippet(body, [porter.stem("enemy"), porter.stem("disengage")], 120)
    assert "enemies disengaged" in got and got.startswith("…") and got.endswith("…")
    assert snippets.snippet("short  text\nhere", ["none"]) == "short text here"
    assert snippets.snippet("é" * 200, ["x"], 101).rstrip("…") == "é" * 50


def test_names():
    assert names.clean_path(" C:\\work\\x\\ ") == "C:/work/x" and names.clean_path("//host/a//b/") == "//host/a/b" and names.clean_path("/a//b/../c/") == "/a/c"
    for r in ("git@github.com:me/repo.git", "https://user@GitHub.com:443/me/repo/", "ssh://git@github.com/me/repo"):
        assert names.canonical_remote(r) == "github.com/me/repo"
    assert names.canonical_remote("ssh://git@host:2222/a/b.git") == "host:2222/a/b"
    assert names.canonical_remote("file:///srv/x.git") == "/srv/x"
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert names.name_score("/home/a/celestial", "celeste") >= 0.8 and names.name_score("", "x") == 0
