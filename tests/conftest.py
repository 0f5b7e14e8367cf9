import pytest

from sparkloom.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, "tests", "3g")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    ship_package(s)
    yield s
    s.stop()
