import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from salesmart.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark, tmp_path_factory):
    """A small warehouse with known orphans, ties, gaps and a missing country."""
    import fixtures
    from salesmart.plans.etl import build_warehouse

    root = str(tmp_path_factory.mktemp("warehouse"))
    return build_warehouse(spark, fixtures.raw_tables(spark), root)
