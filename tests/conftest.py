import pytest

from gleaner.session import get_session, ship


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", cores="4", memory="4g", partitions=4)
    session.sparkContext.setLogLevel("OFF")
    ship(session)
    yield session


@pytest.fixture(scope="session")
def rows():
    """Collected rows as a sorted list of tuples, by column order given."""

    def get(df, *cols):
        return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)

    return get
