import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rowwarden.session import build_session  # noqa: E402

# Built on import: test modules name columns at their top level.
SESSION = build_session(
    "tests", "local[8]",
    **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
       "spark.driver.memory": "6g"},
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a Column over one column ``x``."""
    def evaluate(inputs, column, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
        rows = df.select("i", column.alias("y")).orderBy("i").collect()
        return [r["y"].asDict(True) if hasattr(r["y"], "asDict") else r["y"] for r in rows]

    return evaluate
