import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from railpulse.session import local_session

    # Only a session's start can set the shared folder.
    shared = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = local_session(8, "railpulse-tests", shared)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
