"""Every query of the catalogue against the SQL that says the same."""

import pytest
from conftest import DATA, same_as_sql

from stepwise.plans.catalogue import FLAGSHIP, ORACLES, QUERIES

NO_ROWS_HERE: set[str] = set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    n = same_as_sql(QUERIES[name](spark, f"{DATA}/sf0.01"), "sf0.01", ORACLES[name])
    assert n or name in NO_ROWS_HERE


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.01").count() > 0


def test_flagship_keeps_its_columns(spark):
    assert FLAGSHIP(spark, f"{DATA}/sf0.001").columns == QUERIES["audit_by_action"](spark, f"{DATA}/sf0.001").columns
