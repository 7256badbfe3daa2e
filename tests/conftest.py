import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from garimpo.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", "4", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
