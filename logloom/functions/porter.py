"""Porter's suffix-stripping algorithm (Program, 1980), from its published rules.

Words with characters outside a-z keep their rules on the letters they have; anything that is not a vowel counts as a
consonant, so digits and other scripts pass through unless they end in an English suffix.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

VOWELS = "aeiou"

STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonants(word: str) -> list[bool]:
    """Whether each letter is a consonant; y is one at the start and after a vowel."""
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(not out[i - 1] if c == "y" and i else c not in VOWELS)
    return out


def measure(stem: str) -> int:
    """Vowel-consonant sequences of the stem."""
    kinds = _consonants(stem)
    return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if not a and b)


def _has_vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _cvc(word: str) -> bool:
    kinds = _consonants(word)
    return len(word) > 2 and kinds[-3] and not kinds[-2] and kinds[-1] and word[-1] not in "wxy"


def _step1(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and _has_vowel(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and _has_vowel(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            word = cut + "e"
        elif _doubled(cut) and cut[-1] not in "lsz":
            word = cut[:-1]
        else:
            word = cut + "e" if measure(cut) == 1 and _cvc(cut) else cut
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    return word


def _longest(word: str, rules: tuple) -> tuple[str, str] | None:
    return max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a small-letter word."""
    if len(word) <= 2:
        return word
    word = _step1(word)
    for rules in (STEP2, STEP3):
        rule = _longest(word, rules)
        if rule and measure(word[: -len(rule[0])]) > 0:
            word = word[: -len(rule[0])] + rule[1]
    rule = _longest(word, tuple((s, "") for s in STEP4))
    if rule:
        base = word[: -len(rule[0])]
        if measure(base) > 1 and (rule[0] != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if measure(base) > 1 or measure(base) == 1 and not _cvc(base):
            word = base
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(ArrayType(StringType()))
def stem_all(words: pd.Series) -> pd.Series:
    """Stems of each array's words, in order."""
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


@F.pandas_udf(StringType())
def porter_stem(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))
