"""Registered queries against their comparison SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check_oracle import canonical

from .conftest import SF

# Streams have tests of their own.
SLOW = ("b05", "b06", "b07", "b08_stream", "c09", "t10", "t11", "t12", "t05")
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith(SLOW))


def test_every_comparison_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert canonical(got).equals(canonical(want))


@pytest.mark.parametrize("mode", ["mesa", "anomalia", "discrepancia", "fecha", "tipo"])
def test_list_order(spark, duck, mode):
    from tallyaudit.plans import list_queries
    from tallyaudit.plans.views import with_views

    got = [r.sheet_id for r in entry.queries()[f"p04_sort_{mode}"](spark, SF).collect()]
    sql = with_views(f"SELECT sheet_id FROM v_listing ORDER BY {list_queries._ORDERS[mode]}", "v_listing")
    assert got == [r[0] for r in duck.execute(sql).fetchall()]
