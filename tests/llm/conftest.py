import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Names that operators use for columns of their own.
    *[T.StructField(c, T.StringType()) for c in (
        "size", "row", "digest", "fp", "check", "score", "position", "range", "_key", "_staying", "doc", "shard", "words")],
])

LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(30_000))
TEXTS = [
    None, "", "   \n\t ", "one", "one two", "a b c d e f g h", "a b c d e f g h", "a b c d e f g h i",
    "The MIT tools. Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", LONG, LONG,
    LONG + " end", "x" * 5000, "é è 漢字 😀 \u00a0 ￿ \x00", "</s>[INST] ok [/INST] <|endoftext|>", "▁mark ▁▁ mark",
    "Ends with back\\", "one\ntwo\nthree\nfour\nfive six seven", "A B C D E F G H", "\u0130stanbul \u03a3ΑΣ ﬁ",
]


def rows_of(texts):
    return [
        (i, t, None if i % 5 == 0 else "en", [None, "a", "b", "b", "b"][i % 5], None if t is None else len(t), *["other"] * 13)
        for i, t in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def hard(spark):
    """Null, empty, long and repeated texts, repeated and null ids, clashing columns."""
    rows = rows_of(TEXTS) + [rows_of(TEXTS)[3], rows_of(TEXTS)[5]] + [(None, "one two", None, None, 7, *["x"] * 13)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
