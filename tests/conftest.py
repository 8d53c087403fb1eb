import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from squall.session import checkpoint_dir, get_session
    s = get_session("local[4]", app="squall-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)            # local tests only: a fresh temporary folder
    yield s
    s.stop()
