"""Tokenizers and predicates on message texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .porter import stem_all

#: Words without weight in topics.
STOPWORDS = """
the and for with that this from have has had were was are you your will would should could can not but all any they
them their there here when what which who how why about into over after before then than also just like more most some
such only its our out now new use used using get got make made let per via one two way well much many does doing done
same still even back being been because while where each other another both few between during without within along
across off against among around too very really quite rather either neither ever never always often else though although
however therefore thus hence plus whether things something anything everything someone maybe please thanks hello yeah
yes okay need needs want wants look looks see seems seem show shows find found check checking try tried sure thing stuff
bit lot able going come take takes give put set run runs running work works working test tests tested testing code file
files change changes changed update updated add added remove removed create created fix fixed issue error errors fail
failed pass case part end start started game dev team server client app feature system anymore simply certain actually
basically probably currently already exactly properly instead otherwise anyway likely usually especially entirely
completely fully mostly mainly clearly directly immediately correctly possibly possible almost enough again
""".split()

#: Words that name nothing at the end of a relation.
WEAK_ENDPOINTS = """
actual own standard side first last next current main whole full real old entire overall best general specific proper
original previous final little big small large good bad great top bottom left right internal external existing various
certain several different similar latest earlier later single multiple total primary secondary simple basic common exact
correct wrong second third initial default usual entry whatever everyone nobody somewhere
""".split()

#: Forms of the verbs of replacement.
REPLACE_VERBS = "replace replaces replaced replacing supersede supersedes superseded superseding".split()

_STOP, _WEAK, _REPLACE = frozenset(STOPWORDS), frozenset(WEAK_ENDPOINTS), frozenset(REPLACE_VERBS)


def index_words(text: Column) -> Column:
    """Words of the posting list: small letters, 2 to 40 characters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w).between(2, 40))


def stems(words: Column, stemmer: str = "porter") -> Column:
    """``identity`` leaves words as they are, and stays inside the JVM."""
    if stemmer not in ("porter", "identity"):
        raise ValueError(f"unknown stemmer {stemmer!r}")
    return stem_all(words) if stemmer == "porter" else words


def content_words(text: Column) -> Column:
    """Content words in order with repeats: three bytes and more, no stopwords, not all digits."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    return F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*STOPWORDS) & ~w.rlike(r"^\p{Nd}+$"))


def content_terms(text: Column) -> Column:
    return F.array_distinct(content_words(text))


def sentences(text: Column) -> Column:
    return F.split(text, r"[.!?;\n]")


def is_context(role: Column, text: Column) -> Column:
    """What the host put in, not what was said."""
    start = F.regexp_replace(text, r"^[ \p{Zs}]+", "")
    put_in = (role == "system") | ((role == "user") & (F.startswith(start, F.lit("<")) | F.startswith(start, F.lit("# AGENTS.md"))))
    return F.coalesce(put_in, F.lit(False))  # a null role or text was said


def is_prompt(role: Column, text: Column) -> Column:
    return (role == "user") & ~is_context(role, text)


def is_content(word: str) -> bool:
    return len(word.encode()) >= 3 and word not in _STOP and not all(c.isdecimal() for c in word)


def is_endpoint(word: str) -> bool:
    return is_content(word) and word not in _WEAK




def _tokens(sentence: str) -> list[str]:
    """Runs of letters and decimal digits; an apostrophe is a token of its own."""
    out, run = [], []
    for c in sentence:
        if c.isalpha() or c.isdecimal():
            run.append(c)
            continue
        if run:
            out.append("".join(run))
            run = []
        if c == "'":
            out.append(c)
    if run:
        out.append("".join(run))
    return out


def relations(text: str) -> list[tuple[str, str, str, str]]:
    """Typed relations of a text: (from, to, kind, evidence).

    "X's Y" gives owns; a verb of replacement or "instead of" gives replaces, between the nearest content words on both
    sides, turned round for "replaced by". A pair counts if both ends name a thing.
    """
    out = []
    for raw in re.split(r"[.!?;\n]", text):
        low = raw.lower()
        if not any(sign in low for sign in ("'", "replac", "supersed", "instead")):
            continue  # no rule can apply
        tokens = _tokens(low)
        said = raw.strip()
        said = said[:500] + "…" if len(said) > 500 else said
        for a, quote, s, b in zip(tokens, tokens[1:], tokens[2:], tokens[3:], strict=False):
            if quote == "'" and s == "s" and is_endpoint(a) and is_endpoint(b):
                out.append((a, b, "owns", said))
        for i, t in enumerate(tokens):
            instead = t == "instead" and tokens[i + 1 : i + 2] == ["of"]
            if t not in _REPLACE and not instead:
                continue
            rest = tokens[i + 1 + instead :]
            before = next((w for w in reversed(tokens[:i]) if is_content(w)), "")
            after = next((w for w in rest if is_content(w)), "")
            if is_endpoint(before) and is_endpoint(after) and before != after:
                turned = t in ("replaced", "superseded") and rest[:1] == ["by"]
                out.append((after, before, "replaces", said) if turned else (before, after, "replaces", said))
    return out


_RELATION = StructType([StructField(n, StringType()) for n in ("from_term", "to_term", "kind", "evidence")])


@F.pandas_udf(ArrayType(_RELATION))
def typed_relations(texts: pd.Series) -> pd.Series:
    names = ("from_term", "to_term", "kind", "evidence")
    return texts.map(lambda t: [dict(zip(names, r, strict=True)) for r in relations(t or "")])
