import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ballast.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "ballast-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.log.level": "ERROR",
        },
    )
    yield session
    session.stop()
