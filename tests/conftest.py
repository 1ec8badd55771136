import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fieldloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, "tests", "4g")


def rows(df, *columns):
    """Rows as a sorted list of tuples, missing values first."""
    names = columns or df.columns
    return sorted((tuple(r[c] for c in names) for r in df.select(*names).collect()),
                  key=lambda t: tuple((v is not None, v) for v in t))
