import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rootcause.session import build_session
    s = build_session("local[4]", 8, app_name="rootcause-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="rootcause-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from rootcause.sources.adapters import telemetry_tables
    return telemetry_tables(spark, SF_SMALL)


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
