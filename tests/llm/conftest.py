import pytest

TEXTS = [(1, "The cat sat on the mat and looked at the moon. " * 4), (2, None), (3, ""), (4, "The cat sat on the mat and looked at the moon. " * 4), (None, "lost id"), (5, "x"), (5, "x"), (6, "1 2 3 !"), (7, "Ünïcödé <|endoftext|> don't  stop\n\n\tnow ’s 日本"), (8, "long " * 60_000), (9, "the cat sat on the mat and looked at the moon. " * 4 + "tail")]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, copies, repeated rows, and extra columns with names that operators use."""
    rows = [(i, t, "a", 1.0, "b", 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, score double, shard_ string, N_TOKENS int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
