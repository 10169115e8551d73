"""Every query with SQL equals DuckDB at the smallest size; the others give rows."""

from __future__ import annotations

import pytest
from conftest import canonical, duck

from plenaria.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    mine = QUERIES[name](spark, SF).toPandas()
    theirs = duck(SF).execute(ORACLE_SQL[name]).df()
    assert canonical(mine) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
