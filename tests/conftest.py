import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for Python workers


@pytest.fixture(scope="session")
def spark():
    from trajlake.session import session

    s = session("tests", os.environ.get("TEST_MASTER", "local[4]"), spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-tests-"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
