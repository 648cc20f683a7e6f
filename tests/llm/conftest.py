import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from conftest_llm import odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above with columns whose names clash with inner ones."""
    from shardwell.llm import runtime

    runtime.prepare(spark)
    extra = [(*r, "x", "y", 3, 4) for r in odd_rows()]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, `row` string, norm string, h long, id long").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
