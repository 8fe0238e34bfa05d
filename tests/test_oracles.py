"""Every registered query against its oracle SQL on the same tables."""

import pytest
from compare import difference, duck

from tallymark.workloads import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_oracle(name, spark, sf_dir, con):
    assert difference(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_oracle_gives_rows(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
