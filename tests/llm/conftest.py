import pytest


@pytest.fixture(scope="session")
def llm_queries():
    from tidewell.llm import registry

    return registry.queries()
