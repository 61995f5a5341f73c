import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from peptarium.session import ROWS_PER_TASK_CONF, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "4"), "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sliced(spark):
    """Force the path for tables larger than one task."""
    spark.conf.set(ROWS_PER_TASK_CONF, "40")
    yield spark
    spark.conf.unset(ROWS_PER_TASK_CONF)
