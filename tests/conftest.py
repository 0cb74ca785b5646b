import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tracesieve.session import build_session  # noqa: E402
from tracesieve.streaming.jobs import use_state_store  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", 8)
    use_state_store(s)
    yield s
    s.stop()


@pytest.fixture
def lines_of(spark):
    """Line table (file, line_no, raw, code) of named source texts."""
    from tracesieve.operators.structure import source_lines

    def make(**texts):
        return source_lines(spark.createDataFrame(list(texts.items()), "name string, text string"), "name", "text")
    return make
