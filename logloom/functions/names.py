"""Project names: paths, git remotes, and likeness."""

from __future__ import annotations

import os
import posixpath
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

MIN_SCORE = 0.8


def clean_path(value: str) -> str:
    """A project value in one shape: home expanded, slashes forward, no repeated or trailing ones; UNC roots stay."""
    value = value.strip()
    if value == "~" or value[:2] in ("~/", "~\\"):
        value = os.path.expanduser("~") + value[1:]
    value = value.replace("\\", "/")
    if not value:
        return ""
    cleaned = posixpath.normpath(value)
    if value.startswith("//"):
        return "/" + cleaned.lstrip("/") if cleaned.strip("/") == "" else "//" + cleaned.lstrip("/")
    return "/" + cleaned.lstrip("/") if cleaned.startswith("//") else cleaned


def base_name(value: str) -> str:
    last = posixpath.basename(clean_path(value))
    return "" if last in (".", "..") else last


def _without_git(path: str) -> str:
    path = path.strip().removesuffix("/")
    return path[:-4] if path.lower().endswith(".git") else path


def canonical_remote(remote: str) -> str:
    """One spelling for the ssh, scp-like and https addresses of a remote; a local remote becomes its path."""
    r = remote.strip()
    if not r:
        return ""

    def joined(host: str, path: str) -> str:
        path = _without_git(path).strip("/")
        return "/".join(filter(None, [host.lower(), path])) if host else clean_path(path)

    if r.lower().startswith("file://"):
        return clean_path(_without_git(urlsplit(r).path))
    if re.match(r".:[/\\]", r):
        return clean_path(_without_git(r))
    if "://" in r:
        try:
            u = urlsplit(r)
            host, port = u.hostname or "", u.port
        except ValueError:
            return clean_path(_without_git(r))
        if not host:
            return clean_path(_without_git(r))
        return joined(host if port in (None, 22, 80, 443) else f"{host}:{port}", u.path)
    host, colon, path = r.partition(":")
    if colon and host and "/" not in host and (host := host.rpartition("@")[2]):
        return joined(host, path)
    return clean_path(_without_git(r))


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken: dict[int, int] = {}
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if b[j] == c and j not in taken:
                taken[j] = i
                break
    m = len(taken)
    if not m:
        return 0.0
    swapped = sum(a[i] != b[j] for i, j in zip(sorted(taken.values()), sorted(taken), strict=True))
    return (m / len(a) + m / len(b) + (m - swapped / 2) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """The bonus of a common beginning of up to four characters holds at any likeness."""
    j = jaro(a, b)
    return j + 0.1 * len(os.path.commonprefix([a[:4], b[:4]])) * (1 - j)


def name_score(a: str, b: str) -> float:
    """Likeness of two projects' last names; a common beginning of five bytes and more counts by its length."""
    x, y = base_name(a).lower(), base_name(b).lower()
    if not x or not y:
        return 0.0
    shared = len(os.path.commonprefix([x.encode(), y.encode()]))
    return max(jaro_winkler(x, y), MIN_SCORE + 0.04 * (shared - 5) if shared >= 5 else 0.0)


@F.pandas_udf(StringType())
def clean_path_column(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else clean_path(v))


@F.pandas_udf(StringType())
def canonical_remote_column(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else canonical_remote(v))


@F.pandas_udf(DoubleType())
def name_score_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else name_score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def jaro_winkler_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
