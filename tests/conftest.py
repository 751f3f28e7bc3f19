import pytest

from gatelight.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("gatelight-tests", shuffle_partitions=4)
    yield session
    session.stop()


def rows(df, *names):
    """Sorted tuples of the named columns."""
    got = df.select(*names).collect() if names else df.collect()
    return sorted((tuple(r) for r in got), key=repr)
