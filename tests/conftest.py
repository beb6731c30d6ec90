import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.session import drop_stages, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "6g")


@pytest.fixture(autouse=True, scope="module")
def stages(spark):
    """No table of one test module stays for the next."""
    yield
    drop_stages(spark)
