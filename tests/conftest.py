import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sourcemeld.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def scratch(spark):
    from sourcemeld.session import Scratch

    s = Scratch(spark)
    yield s
    s.close()


@pytest.fixture()
def tiny_limits(monkeypatch):
    """Thresholds so low that the plans for hot keys and large lookups run on small data."""
    from sourcemeld.operators import skew
    from sourcemeld.settings import Limits

    monkeypatch.setattr(skew, "LIMITS", Limits(hot_rows=3, broadcast_rows=2, tile_rows=5))
