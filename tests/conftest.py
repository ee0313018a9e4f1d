import pytest


@pytest.fixture(scope="session")
def spark():
    from quillon.session import session

    s = session("tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
