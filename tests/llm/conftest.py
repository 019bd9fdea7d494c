import pytest
from pyspark.sql import functions as F

from wardflow.llm._util import Workspace

SHARED = " ".join(f"w{i}" for i in range(40))
#: Nulls, empty and white-space texts, ties, repeated rows, near copies, shared passages, odd characters, a long text.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today", "en", "b", 1),
    (3, None, None, None, None),
    (4, "", "de", "c", 0),
    (5, " \n\t \x0b\x0c\r ", "de", "c", 0),
    (6, "one", "fr", "b", 3),
    (7, "Zwölf  Boxkämpfer  jagen　\n\nViktor   quer 😀😀 über den\x85großen ", "de", "b", 3),
    (16, "a\u00a0  b\u2003  \u2003 c\u3000\u3000  d\u00a0\u00a0 \n e  ", "de", "b", 3),
    (8, f"Start here {SHARED} and end there", "en", None, 9),
    (9, f"{SHARED} tail {SHARED}", "en", "d", 9),
    (None, f"null id {SHARED}", "en", "d", 9),
    (10, "ha ha ha " * 60, "en", "a", 9),
    (11, "same line\nsame line\nother # line\n\n same line\n" * 30, "en", "a", 9),
    (12, "Dr. Anna Weber wrote to anna.weber@mail.example.com from 10.1.2.3; call +44 20 7946 0958.", "en", "e", 9),
    (13, "Later Dr Weber paid with 4111 1111 1111 1111; mail anna.weber@mail.example.com again.", "en", "e", 9),
    (14, " ".join(f"long{i % 977} x{i}" for i in range(30_000)), "en", "a", 9),
    (15, " ".join(f"Good{i} sentence, number {i} with ordinary words." for i in range(30)), "en", "a", 9),
]


@pytest.fixture(scope="session")
def tricky(spark):
    """The rows above, with extra columns of names that operators use inside."""
    out = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["size", "bucket", "start", "fp", "hash", "w", "row_key", "label", "n", "key", "host", "rank", "item_id", "x", "rule", "chunk", "again", "taken", "_w", "_n", "_row"]
    return out.repartition(4).withColumns({c: F.lit(f"extra {c}") for c in extra})


@pytest.fixture(scope="session")
def no_rows(tricky):
    return tricky.where("doc_id < -5")


@pytest.fixture
def space(spark):
    return Workspace(spark)
