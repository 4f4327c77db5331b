"""The corpus queries that have SQL give what DuckDB gives for it."""

from pathlib import Path

import pytest

from inkwell.llm import catalog
from tests.test_oracles import SF, compare


@pytest.mark.skipif(not Path(SF).is_dir(), reason="the tables are not there")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, catalog.queries()[name], catalog.oracle_sql()[name])
