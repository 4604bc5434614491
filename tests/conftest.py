import pytest

from tessera.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session(8, "tests")
    s.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('shared')}")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
