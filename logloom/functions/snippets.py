"""Snippets around the densest run of query stems."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_WORD = re.compile(r"\w+")


def stem_matches(word: bytes, stem: bytes) -> bool:
    if word.startswith(stem):
        return len(stem) >= 4 or len(word) <= len(stem) + 1
    return len(stem) >= 5 and word.startswith(stem[:-1])


def snippet(text: str, stems: list[str], width: int = 240) -> str:
    """About ``width`` bytes of the text, white space collapsed, where most distinct stems stand close together."""
    raw, keys = text.encode(), [s.encode() for s in stems]
    found: list[tuple[int, int, int]] = []
    at = seen = 0
    for m in _WORD.finditer(text):
        at += len(text[seen : m.start()].encode())
        size = len(m[0].encode())
        low = m[0].lower().encode()
        which = next((i for i, s in enumerate(keys) if stem_matches(low, s)), None)
        if which is not None:
            found.append((at, at + size, which))
        at, seen = at + size, m.end()
    start = 0
    if found:
        best = (0, 0)
        for i, (a, _, _) in enumerate(found):
            inside = []
            for x in found[i:]:
                if x[1] - a > width * 3 // 4:
                    break
                inside.append(x[2])
            if (score := (len(set(inside)), len(inside))) > best:
                best, start = score, a
        start = max(0, start - width // 5)
    if start:
        head = raw[max(0, start - 20) : start]
        space = max(head.rfind(c) for c in (b" ", b"\n", b"\t"))
        if space >= 0:
            start = max(0, start - 20) + space + 1
        while start < len(raw) and raw[start] & 0xC0 == 0x80:
            start += 1
    stop = min(start + width, len(raw))
    while start < stop < len(raw) and raw[stop] & 0xC0 == 0x80:
        stop -= 1
    body = " ".join(raw[start:stop].decode(errors="ignore").split())
    return ("…" if start else "") + body + ("…" if stop < len(raw) else "")


def snippet_column(text: Column, stems: list[str], width: int = 240) -> Column:
    @F.pandas_udf(StringType())
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t or "", stems, width))

    return made(text)
