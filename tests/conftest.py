import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from arbor.session import local_session
    from arbor.storage import release_scratch

    session = local_session("4", "4g", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release_scratch(session)
    session.stop()


@pytest.fixture()
def rows():
    """Sorted tuples of a frame."""
    def sort(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(x) for x in r))

    return sort
