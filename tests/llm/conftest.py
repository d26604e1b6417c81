import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import pytest  # noqa: E402
from conftest_llm import prose  # noqa: E402

#: Columns that clash with what operators name their own.
EXTRA = "score double, toxic boolean, ids array<int>, `start` int, rep bigint, sig binary, bucket bigint, gram bigint, bits double, keep boolean, `row` int, item_id bigint, __with_ids bigint, jaccard double"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + EXTRA


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, and clashing columns."""
    none = (None,) * 14
    long = prose(1, 60_000)
    rows = [(None, None, None, None, None, *none), (1, None, "en", "s", 0, *none), (2, "", "en", "s", 0, *none), (3, " \n\t", None, "s", 3, *none), (None, "a text without an id", "en", None, None, *none), (4, "word", "en", "s", 4, *none), (4, "word", "en", "s", 4, *none), (5, "🙂 héllo \x00 wörld 漢字", "en", "s", 20, *none), (6, long, "en", "s", len(long), *none), (7, "x" * 5000, "en", "s", 5000, *none), (8, "!!! ... ###", "en", "s", 11, *none)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
