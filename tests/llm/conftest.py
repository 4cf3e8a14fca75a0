import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    import random
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, one long text, odd characters."""
    long = prose(1, 30_000)
    rep = prose(2, 12)
    return [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n ", "en", "a", 4), (None, "no id here", "en", "a", 1),
        (3, "one", "en", "b", 3), (4, "ONE", "fr", None, 3), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3),
        (6, long, "en", "b", len(long)), (7, (rep + "\n") * 9, "de", "c", 9), (8, "É é ß x y", "fr", "c", 5),
        (9, prose(3, 60), "en", "a", 1), (10, prose(3, 60).upper(), "en", "a", 1), (11, prose(4, 40) + " ### $$$ ***", "en", "é", 1),
        (12, prose(5, 25), "en", "é", 1), (13, prose(5, 25) + " tail", "en", "é", 1), (None, None, None, None, None),
        (14, prose(6, 8) + " " + prose(6, 8) + " " + prose(7, 30), "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
