import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rulesift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="rulesift-tests")
    yield s
    s.stop()


@pytest.fixture
def files_df(spark):
    """Build a code_files DataFrame from (path, text) pairs of one repository."""
    def make(items, repo="org/r", branch="main"):
        rows = [(repo, branch, p, t) for p, t in items]
        return spark.createDataFrame(rows, "repo string, branch string, path string, text string")
    return make
