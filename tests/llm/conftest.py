import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from tidewell.llm.common import ship_code

    ship_code(spark)
