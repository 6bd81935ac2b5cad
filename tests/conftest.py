from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from swathe.session import local_session, ship_package

    session = local_session(cpus=4, memory="4g", name="tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def matrix(spark):
    """Rows (row, col, n) of a nested list."""

    def make(rows, name="n", kind="int", **more):
        data = [(r, c, float(v) if kind == "double" else v, *more.values()) for r, line in enumerate(rows) for c, v in enumerate(line)]
        schema = f"row int, col int, {name} {kind}" + "".join(f", {k} string" for k in more)
        return spark.createDataFrame(data, schema)

    return make
