"""Plan-shape guards for the scale properties (see README, 'Designed for 100 TB')."""

import pytest

from ledgerframe.plans import golden as G
from ledgerframe.plans.reports import operations, product

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _ancestors(plan: str, needle: str) -> list[str]:
    """Operator lines above the first line containing ``needle``."""
    lines = plan.splitlines()
    idx = next(i for i, ln in enumerate(lines) if needle in ln)
    depth = len(lines[idx]) - len(lines[idx].lstrip(" :+-"))
    out = []
    for ln in reversed(lines[:idx]):
        d = len(ln) - len(ln.lstrip(" :+-"))
        if d < depth:
            out.append(ln.strip(" :+-"))
            depth = d
    return out


def test_fact_table_is_never_broadcast(spark):
    plan = _plan(G.golden_from_tables(spark, SF))
    above = _ancestors(plan, "lineitem.parquet")
    assert not any(a.startswith("BroadcastExchange") for a in above)
    assert any(a.startswith("SortMergeJoin") for a in above)


@pytest.fixture(scope="module")
def g(spark):
    return G.golden_from_tables(spark, SF)


def test_whole_partition_stats_are_not_windows(g):
    assert "Window" not in _plan(product.bcg_matrix(g))            # category totals joined back
    assert "Window" not in _plan(operations.status_fulfilment(g))   # SUM(COUNT(*)) OVER () as a scalar
