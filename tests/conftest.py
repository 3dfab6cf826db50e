import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from corefold.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cpus=4, shuffle_partitions=4, driver_memory="4g")
    yield s
    s.stop()
