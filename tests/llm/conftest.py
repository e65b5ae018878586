import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers_llm import prose  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Texts at the edges: null, empty, blank, one word, very long, not ASCII, repeated rows, null ids, clashing columns."""
    long = "\n".join(prose(60, i % 40) for i in range(600)) + " x" * 3000 + "é" * 5000
    rows = [
        (1, "", "en", "a", 0), (2, None, "en", None, None), (3, " \t\n \r\v\f", None, "a", 7), (4, "one", "de", "a", 3),
        (5, long, "en", "a", 1), (6, "ünï cödé 文字 текст     x́ ﬁ İı ſ K", "fr", "b", 2),
        (7, prose(40, 1), "en", "a", 2), (7, prose(40, 1), "en", "a", 2), (None, prose(40, 2), "en", "a", 2),
        (None, None, None, None, None), (8, "a b c d e " * 30, "en", "a", 1), (9, prose(40, 1).upper(), "en", "a", 3),
        (10, "\n".join([prose(12, 5)] * 6), "en", "b", 4), (11, "x" * 70_000, "en", "b", 4), (7, prose(45, 9), "en", "b", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "doc_id AS row", "lang AS chunks", "1 AS n", "2 AS cid", "3 AS part", "'i' AS ids", "4 AS rank", "5 AS class",
        "6 AS bucket", "7 AS text_hash", "8 AS spans", "9 AS stratum", "10 AS token", "11 AS m", "12 AS kept", "13 AS score")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
