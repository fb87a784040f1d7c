import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from concord.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, **{"spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rng():
    return np.random.default_rng(7)


@pytest.fixture
def make_items(spark):
    """(id, vec) DataFrame of the rows of a matrix."""

    def make(matrix, **columns):
        rows = [(i, [float(v) for v in row], *[c[i] for c in columns.values()]) for i, row in enumerate(matrix)]
        kinds = "".join(f", {n} {'int' if isinstance(c[0], (int, np.integer)) else 'string'}" for n, c in columns.items())
        rows = [tuple(int(v) if isinstance(v, np.integer) else v for v in r) for r in rows]
        return spark.createDataFrame(rows, f"id long, vec array<double>{kinds}")

    return make
