import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tessella.session import local_session

    os.environ.setdefault("TZ", "UTC")
    session = local_session(cores=8, shuffle_partitions=4, name="tests")
    yield session
    session.stop()
