import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from aerolake.session import build_session

    session = build_session(
        "aerolake-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_tasks(spark):
    """Force the split plans: no task may order more than a few rows of one key."""
    spark.conf.set("aerolake.maxRowsPerTask", "25")
    yield
    spark.conf.unset("aerolake.maxRowsPerTask")
