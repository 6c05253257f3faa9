import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from seguelake.session import local_session

    session = local_session("tests")
    yield session
    session.stop()


@pytest.fixture()
def small_groups(spark):
    """Treat every group above four rows as too large for one task."""
    spark.conf.set("seguelake.hotGroupRows", "4")
    yield spark
    spark.conf.unset("seguelake.hotGroupRows")
