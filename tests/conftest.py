from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from marquee.session import build_session, checkpoint_dir

    s = build_session("local[*]", app_name="marquee-tests", shuffle_partitions=8)
    # tests only: a checkpoint folder when the cluster names none
    checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="run-ckpt-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_out():
    return tempfile.mkdtemp(prefix="run-test-", dir="/tmp")


def rows(df, *cols):
    """Sorted list of tuples of the given columns (all columns when none given)."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
