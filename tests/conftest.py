import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ.setdefault("PYTHONPATH", str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tidemill.session import session

    made = session("tests", 4, spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    yield made
    made.stop()
