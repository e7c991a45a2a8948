import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean, size int, "
          "candidate int, sieve_word int, label int, `a.b` int, part int, read int, key string")
EXTRA = ("r", True, 7, 1, 1, 0, 5, 3, 2, "k")


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    texts = [(1, "one two three four five six"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, LONG + " end"),
             (7, "onetwothreefourfivesix"), (8, "é ü 𝒳 ß"), (None, "no id at all"), (None, None), (1, "one two three four five six"),
             (9, "one two three four five six"), (10, "x" * 50_000)]
    rows = [(d, t, "en", f"s{(d or 0) % 3}", len(t or ""), *EXTRA) for d, t in texts]
    return rows + [(None,) * 15, (11, "plain", None, None, None, *(None,) * 10)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
