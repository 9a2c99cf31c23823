import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from compare import session

    s = session()
    s.sparkContext.environment["PYTHONPATH"] = str(ROOT)
    return s


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with the names that operators use."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = " ".join(f"{word[i % 10]}{i * i % 97}" for i in range(30_000))
    rows = [(1, "one two three four five six seven eight nine ten eleven"), (1, "one two three four five six seven eight nine ten eleven"), (2, None), (None, "lost words here"), (None, None), (3, ""), (4, " \t\n"), (5, long), (6, long), (7, "x")]
    return spark.createDataFrame([(i, t, "a", 1, True, 0.5) for i, t in rows], "doc_id long, text string, node string, mix int, kept boolean, tkey double")
