import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

#: Rows with nulls, an empty and a very long text, repeated rows, a null id, and columns that clash.
AWKWARD = [
    (1, "The cat sat on the mat and then the cat left the mat again", "en", "s1"),
    (2, "the CAT sat on the mat and then the cat left the mat again", "en", "s1"),
    (3, None, None, None),
    (4, "", "en", None),
    (5, "word " * 30000, "en", "s2"),
    (6, "x" * 200000, None, "s2"),
    (7, " \t\n ", "de", "s1"),
    (7, " \t\n ", "de", "s1"),
    (None, "no id here at all my friends", "en", "s1"),
    (8, "Der Hund und die Katze\nsind nicht da. Été 日本 🙂", "de", "s3"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """documents whose extra columns bear names that results use."""
    rows = [(*r, i, "x", 0.5, True, b"k", 1, *range(10)) for i, r in enumerate(AWKWARD)]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, rank long, digest string, score double, kept boolean, key binary, size int, "
        "_id int, _copies int, _copy int, _pid int, _rank int, _key int, _row int, sequence_id int, lang_pred int, `a.b` int",
    )
