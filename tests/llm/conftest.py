import pytest

#: Nulls, empty and blank texts, repeats, a long text, odd characters, many texts for a doc_id.
TEXTS = [
    (1, "the cat sat on the mat and the dog ran off"), (2, None), (3, ""), (4, "   \n\t "), (5, "The CAT sat on the mat and the dog ran off"),
    (6, "naïve café — 漢字かな 🙂 don't we'll 'twas 12½ x\u00a0y\x00z"), (7, "word " * 20_000), (8, "a"), (8, "a"), (None, "null id"), (None, None),
    (9, "Licensed under the Apache License, Version 2.0. Released under the MIT License. CC BY-NC 4.0"), (10, "b" * 5000), (11, "  lead  and   trail  "),
]
SCHEMA = "doc_id long, text string, size int, shard string, ids string, fp string, score string, held_out string, label string, media string, `a b` int"


@pytest.fixture(scope="session")
def docs(spark):
    """Odd rows, with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "s", "i", "f", "c", "h", "l", "m", 2) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
