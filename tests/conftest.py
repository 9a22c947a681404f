import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quern.session import build_session, ship_code

    session = build_session("tests", "local[4]", 4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("ERROR")
    ship_code(session)
    yield session
    session.stop()
