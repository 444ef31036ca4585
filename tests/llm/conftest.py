import pytest
from pyspark.sql import types as T

PROSE = "the cat and the dog of this house is in a very old town for people with much time on hand "
LONG = "".join(f"word{i} of the long text number {i * 7} is here. " for i in range(9000))
CLASHING = ("n_words", "labels", "score", "fingerprint", "fp", "spans", "blob", "kept", "ids", "n_tokens", "key", "start",
            "component_id", "cut_text", "hashes", "row")


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty, blank, long, repeated and odd texts, and columns called like results."""
    texts = [None, "", " \t\n ", "one", PROSE * 12, PROSE * 12, PROSE * 12 + "x", LONG, "\U0001F600 É́ ẞ " * 30,
             "password = \"hunter2xyz\" and token=ab secret=token: abcdefgh " + "deadbeef" * 4, "a" * 3000,
             "Licensed under CC BY-NC 4.0. All rights reserved. all rights reserved", "x\n" * 80, "<|endoftext|> it's"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], (4, "another text of the same key", None, None, None), (None, "no key", "en", None, 6),
             (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    for c in CLASHING:
        df = df.selectExpr("*", f"'own' AS {c}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def sorted_rows():
    return rows_of


@pytest.fixture(scope="session")
def benchmark(spark):
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("spans", T.StringType())])
    items = [(1, "Cat and the dog of this house is in a very old town, for people", "x"), (2, "no key", None),
             (2, "no key", None), (None, "much time on hand", None), (4, None, None), (5, "", None), (10, "one", None),
             (7, "word5 of the long text number 35 is here word6 of the long", None)]
    return spark.createDataFrame(items, schema)
