import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from folioscope.session import build_session, prepare


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("folioscope-tests", cores=4, shuffle=8, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield prepare(session)
