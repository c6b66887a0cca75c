import pytest

from tesserae.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])
