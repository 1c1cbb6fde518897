"""Every bound query with a SQL twin against DuckDB on the smallest data.

The twins of the training-data queries are checked beside their operators.
"""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import DATA, compare, connect

SF = f"{DATA}/sf0.001"
NAMES = [n for n in entry.oracle_sql() if not re.match(r"op\d+_|pipeline$", n)]
#: Queries that rightly find nothing in so little data.
EMPTY = {"list_atoms", "bulk_import_alert", "dead_letter_alerts", "import_rate_stream"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    result, rows, _, _ = compare(spark, con, SF, name)
    assert result == "match", result
    assert rows > 0 or name in EMPTY
