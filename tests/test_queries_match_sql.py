"""Every registered query with SQL of its own returns the SQL's rows; the others return rows with stable columns."""

from __future__ import annotations

import pytest

from neume.plans import registry
from tests.compare import spark_rows, sql_rows
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    assert spark_rows(registry.queries()[name](spark, SF)) == sql_rows(registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_again_alike(spark, name):
    run = registry.queries()[name]
    assert spark_rows(run(spark, SF)) == spark_rows(run(spark, SF))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(__spark_entry__.queries())
