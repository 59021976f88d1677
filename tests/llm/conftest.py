import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and an extra column with an operator's own name."""
    long_line = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, "one", None), (4, "one", "y"), (None, "some words here", "z"), (None, None, None),
            (5, long_line, "x"), (5, long_line, "x"), (6, long_line + " tail", "x"), (7, " \n\n ", "x"), (8, "é ü 漢字 \U0001F600", "x"),
            (9, "1" * 5000, "x"), (10, "a" * 5000 + "@", "x")]
    return spark.createDataFrame([(*r, i, 0.5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, bucket int, score double")
