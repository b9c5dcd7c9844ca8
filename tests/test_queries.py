"""Every query against its SQL in DuckDB; queries without SQL give rows."""

import pytest
from oracle import assert_same

from linkmosaic.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), sf_dir, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).columns
