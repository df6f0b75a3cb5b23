from __future__ import annotations

import pytest

from tallymart.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, "tallymart-tests", **{"spark.driver.memory": "4g", "spark.sql.warehouse.dir": "/tmp/tallymart-warehouse"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
