from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from querylens.operators.parse import parse_lines  # noqa: E402
from querylens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def parse(spark):
    """Entries of the given lines, numbered in order."""

    def run(text, log_format="auto"):
        lines = text.split("\n") if isinstance(text, str) else text
        rows = [("target", i, line) for i, line in enumerate(lines)]
        df = spark.createDataFrame(rows, "source_window string, record_index bigint, value string")
        return parse_lines(df, log_format)

    return run
