from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folio.session import local_session  # noqa: E402

DATA = os.environ.get("FOLIO_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session("8", "folio-tests", partitions=8, spark__checkpoint__dir=str(shared))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    if not os.path.isdir(DATA):
        pytest.skip(f"no test data in {DATA}")
    return DATA


def collect(df, *columns):
    """Rows as a sorted list of tuples (single values when one column is asked for)."""
    rows = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    out = [r[0] if len(r) == 1 else r for r in rows]
    return sorted(out, key=repr)
