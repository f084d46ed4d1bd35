import duckdb
import pytest

EDGE = [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "one"), (-5, "one two"), (-6, "Ünï çödé ☃ 漢字 😀"), (-7, "x" * 5000), (-8, "the end. " * 3000), (-9, "<|endoftext|> </s>[INST] <s>"), (-10, "same text here again"), (-11, "same text here again")]


@pytest.fixture(scope="session")
def texts(data):
    """Keys and texts of a small table, and odd ones."""
    return duckdb.connect().sql(f"select doc_id, text from '{data}/documents.parquet' order by 1").fetchall() + EDGE


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The same as a table with further columns, some of them with names that operators use themselves."""
    rows = [(k, t, "a", 1, "b", 0.5, 7) for k, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens int, label string, score double, start long").repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
