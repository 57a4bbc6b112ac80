"""Those queries of the subpackage that SQL can say equal it."""

import pytest
from test_oracle import DATA, check, db  # noqa: F401  db is a fixture

from ionquarry.llm import queries

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, db, name):  # noqa: F811
    check(spark, db, name)
