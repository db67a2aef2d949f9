import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import connect, differences  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from rowwarden.queries import registry  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_agrees_with_its_sql(spark, con, name):
    assert name in entry.oracle_sql()
    assert differences(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
