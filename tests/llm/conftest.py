import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

LONG = " ".join(f"w{k} of the" for k in range(40_000))
#: id, text, source: nulls, empty and blank texts, a very long one, repeated rows, an equal id with another text.
EDGE = [
    (None, "null id here", "a"), (1, None, "a"), (2, "", "b"), (3, " \t\n ", None), (4, "one", "b"), (5, "one two", "b"), (6, LONG, "c"), (7, "repeated row text here", "c"), (7, "repeated row text here", "c"),
    (8, "repeated row text here", None), (9, "same id", "d"), (9, "other text of that id", "d"), (10, "Ünïcode 😀 日本語 text\n\nsecond section.\nline", "d"), (11, "x" * 70_000, "d"), (12, "A B c", "e"),
]
CLASHES = "score double, id int, t string, size int, held_out string, _salt int, fp int, file int, rank int, n int"


@pytest.fixture(scope="session")
def edge(spark):
    extra = (0.5, 1, "t", 2, "h", 3, 4, 5, 6, 7)
    return spark.createDataFrame([(*r, *extra) for r in EDGE], f"doc_id long, text string, source string, {CLASHES}").repartition(3)


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")
