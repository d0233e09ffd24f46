from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabchain.session import build_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        shuffle_partitions=4,
        extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.maxMetadataStringLength": "10000"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


@pytest.fixture(scope="session")
def value(spark):
    """Value of one SQL expression, over columns of one row if given."""

    def run(expression: str, schema: str | None = None, row: tuple | None = None):
        df = spark.createDataFrame([row], schema) if schema else spark.range(1)
        return df.selectExpr(f"{expression} AS v").first().v

    return run
