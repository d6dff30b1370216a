import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from qplate.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="qplate-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect ``cols`` as sorted tuples (order-insensitive comparisons)."""
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
