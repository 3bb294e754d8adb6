"""Every query against its SQL on the smallest tables."""

import pytest

import oracle
from cantorium.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    if name in registry.ORACLES:
        oracle.same(spark, registry.QUERIES[name], registry.ORACLES[name], SF)
    else:
        frame = registry.QUERIES[name](spark, SF)
        assert [tuple(r) for r in frame.collect()] and len(set(frame.columns)) == len(frame.columns)
