import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewatt.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.log.level": "ERROR",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    yield session
    session.stop()


def hours(start, n, region="caiso", load=lambda i: float(i), skip=()):
    """(region, time_utc, load_mw) rows of n consecutive hours."""
    from datetime import datetime, timedelta

    first = datetime.fromisoformat(start)
    return [(region, first + timedelta(hours=i), load(i)) for i in range(n) if i not in skip]


PANEL = "region string, time_utc timestamp, load_mw double"


@pytest.fixture
def panel_of(spark):
    return lambda rows, schema=PANEL: spark.createDataFrame(rows, schema)
