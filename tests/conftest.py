import pytest

from respira.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{shared}", spark__driver__memory="4g",
        spark__sql__adaptive__coalescePartitions__enabled="true",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
