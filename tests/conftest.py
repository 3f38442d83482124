import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from hindsight.session import build_session

    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """frame("a long, b string", row, row, ...)"""
    def make(schema, *rows):
        return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)

    return make


def order(row):
    """NULLs last, whatever the types."""
    return tuple((x is None, 0 if x is None else x) for x in row)


def bag(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=order)
