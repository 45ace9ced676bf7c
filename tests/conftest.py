import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    from lakeloom.session import local_session

    session = local_session("tests", partitions=2, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def db(spark, tmp_path):
    from lakeloom import Database

    return Database(spark, f"file://{tmp_path}/db")
