"""Every query of the library against its SQL on the smallest tables; queries without SQL give rows."""

from __future__ import annotations

import pytest
from conftest import SF, same_rows

from quillmill.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same_rows(df, duck, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
