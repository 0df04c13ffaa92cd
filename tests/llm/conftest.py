"""Small documents with the awkward cases, and the smallest input tables."""

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, n int, fp string, k int, bucket string"
ODD = [
    (1, "the quick brown fox jumps over the lazy dog\nshared line\nthe end"),
    (2, None),
    (3, ""),
    (4, "  Shared Line  \n\n\x0bSHARED LINE\t"),
    (5, "a " * 40_000 + "é" * 3000),
    (6, "the quick brown fox jumps over the lazy dog\nshared line\nthe end"),
    (6, "the quick brown fox jumps over the lazy dog\nshared line\nthe end"),
    (None, "no id <|endoftext|> here"),
    (8, "<|im_start|>x\\<|y \\n 中文 \x00 ' 's  "),
    (9, "word"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "x", 2, None) for i, t in ODD], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
