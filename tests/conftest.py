import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from linkgauge.session import build_session

    session = build_session("tests", cores=4)
    yield session
    session.stop()
