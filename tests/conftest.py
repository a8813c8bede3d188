import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from steerframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "tests",
        8,
        **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))},
    )
    yield session
    session.stop()
