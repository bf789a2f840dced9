import numpy as np
import pytest


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty texts, ties, repeated rows, odd white space, other scripts; extra columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. " * 4, "a"), (2, "The quick brown fox jumps over the lazy dog. " * 4, "b"), (3, "The  quick\tbrown fox jumps over the lazy dog. " * 4, "a"), (4, None, "a"), (5, "", None),
        (6, " \n\t ", "b"), (None, "no id at all", "c"), (7, "Ärger µ ½ Σίσυφος 漢字 <|endoftext|> ﬁ it's", "c"), (7, "Ärger µ ½ Σίσυφος 漢字 <|endoftext|> ﬁ it's", "c"), (8, "x", None), (9, "x y", "b"), (10, "word " * 9000, "a"), (11, "Released under the MIT Licence!", "c"),
        (12, "Intro\nLicensed under CC BY-NC 4.0.\nmore", "c"), (13, "(c) 2020 Someone\nReleased under the MIT License.", "c"), (7, "the same id, another text", "b"),
    ]
    return spark.createDataFrame([(*r, 0, "z", 1) for r in rows], "doc_id long, text string, source string, shard int, Slot string, hash int")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture()
def rng():
    return np.random.default_rng(1)
