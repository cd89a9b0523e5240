"""One session for all tests."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("BENCH_CPUS", "4")


@pytest.fixture(scope="session")
def spark():
    from mossbrook.session import build_session

    s = build_session("tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df):
    """Rows as tuples, sorted by their text."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
