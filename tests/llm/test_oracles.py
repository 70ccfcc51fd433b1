import pytest

from millrace.llm import queries
from tests.test_oracles import compare, con  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, spark, sf_dir, con):  # noqa: F811
    compare(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLES[name])
