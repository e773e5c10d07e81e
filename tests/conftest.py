from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def day():
    def make(text: str) -> dt.date:
        return dt.date.fromisoformat(text)

    return make


@pytest.fixture(scope="session")
def random_returns(spark):
    """300 business days of five assets with seeded normals, one universe."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    days = pd.bdate_range("2024-01-01", periods=300).date
    scale = np.array([0.010, 0.013, 0.009, 0.006, 0.008])
    values = rng.normal(0.0004, 1.0, size=(300, 5)) * scale + rng.normal(0, 0.004, size=(300, 1))
    names = ["SPY", "QQQ", "SCHD", "TLT", "GLD"]
    wide = pd.DataFrame(values, index=days, columns=names)
    rows = [("U", d, a, float(wide.loc[d, a])) for d in days for a in names]
    return wide, spark.createDataFrame(rows, "universe_id string, session date, asset string, ret double")
