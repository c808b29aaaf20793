import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use inside.
        T.StructField("score", T.DoubleType()),
        T.StructField("found", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names clash."""

    def build(rows):
        data = [(i, t, "en", "s", None if t is None else len(t), 1.0, "x", "y") for i, t in rows]
        return spark.createDataFrame(data, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """NULLs, empty and very long texts, repeated rows, ties."""
    rows = [(1, "one two three four five six seven"), (2, None), (3, ""), (4, LONG), (5, LONG), (5, LONG), (None, "one two three four five six seven"), (6, " \t\n"), (7, "é日本 ß"), (8, "a\0b")]
    return make(rows)
