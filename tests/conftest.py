import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quirefold.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, partitions=4, memory="8g")
