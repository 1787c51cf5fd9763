import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from iolens.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *cols):
    """The rows of a DataFrame as a sorted list of tuples."""
    got = [tuple(r) for r in df.select(*(cols or df.columns)).collect()]
    return sorted(got, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))
