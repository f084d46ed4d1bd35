"""The functions for SQL users."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType

from . import names, porter, snippets, text, vectors


@F.pandas_udf(ArrayType(FloatType()))
def embed_text(texts: pd.Series) -> pd.Series:
    """The embedding of a whole text."""
    return texts.map(lambda t: None if t is None else vectors.embed(words_of(t)))


@F.pandas_udf(StringType())
def snippet(texts: pd.Series, stems: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([snippets.snippet(t or "", list(s if s is not None else []), int(w)) for t, s, w in zip(texts, stems, width, strict=True)])


def words_of(value: str) -> list[str]:
    """Content words of a text in order, with repeats."""
    return [w for w in text._tokens(value.lower()) if w != "'" and text.is_content(w)]


class ExplodeTerms:
    """A row for each distinct content term of a text: its place and the term."""

    def eval(self, value: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(dict.fromkeys(words_of(value or "")))


def register(spark: SparkSession) -> None:
    for name, f in {
        "porter_stem": porter.porter_stem, "porter_stem_all": porter.stem_all, "analyze_text": text.typed_relations, "embed_words": vectors.embed_words, "embed_text": embed_text,
        "snippet": snippet, "clean_path": names.clean_path_column, "canonical_remote": names.canonical_remote_column, "name_score": names.name_score_column, "jaro_winkler": names.jaro_winkler_column,
    }.items():
        spark.udf.register(name, f)
    from pyspark.sql.types import StructType

    spark.udtf.register("explode_terms", F.udtf(ExplodeTerms, returnType=StructType().add("place", IntegerType()).add("term", StringType())))
