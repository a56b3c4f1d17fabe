import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty and very long texts, repeated rows, a null id, ties, and columns whose names clash with the operators' own."""
    long = " ".join(f"word{i % 977} other{i}" for i in range(15000))
    base = "the quick brown fox jumps over the lazy dog and runs through the wide green forest until night falls on the hills"
    rows = [(1, None), (2, ""), (3, long), (4, base), (5, base), (5, base), (6, base + " again"), (7, "   \n\t "), (8, "short"), (8, "short"), (9, "don't 's  x\n\n y é中🙂 ͸"), (None, base), (10, "GNU General Public License, version 3. MIT License\nMIT License"), (11, long + " tail"), (12, "stop <|endoftext|> and <|startoftext|>go on")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("n", "set", "token", "score", "kept", "part", "shard", "row", "probability", "n_words")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
