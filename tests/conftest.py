import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelf import local_session  # noqa: E402
from shelf.scratch import release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="shelf-tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("SHELF_TEST_SF", "/root/testdata/sf0.001")


def plan_of(df, mode="formatted"):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()
