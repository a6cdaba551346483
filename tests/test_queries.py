"""Every registered query of the library proper against its DuckDB equivalent."""

from __future__ import annotations

import pytest

from tallyhawk.plans import registry
from tests.oracle import same_rows

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_oracle(name, spark, sf):
    same_rows(registry.QUERIES[name](spark, sf), registry.ORACLE[name], sf)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
