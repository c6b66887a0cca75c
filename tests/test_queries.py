import pytest

from tesserae.plans import registry


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_its_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])
