"""The catalogue: SQL equality on the smallest tables, and plan shapes."""

import oracle_check
import pytest

from parcelscope.plans.catalog import QUERIES
from parcelscope.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
QUICK = [
    "sales_summary", "area_activity", "recent_sales", "search_matches", "price_text_parse", "tag_reads", "snapshot_diff", "lifecycle", "hunt_report",
    "agent_rank", "sold_comps", "comp_valuation", "reconcile", "risk_flags", "viability", "inspection_run", "source_status", "page_cards", "stream_supply",
]


@pytest.fixture(scope="module")
def duck():
    return oracle_check.connection(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, duck, name):
    assert oracle_check.compare(spark, duck, SF, name) is None


@pytest.mark.parametrize("name", ["sold_comps", "lifecycle", "risk_flags", "sales_summary", "agent_metrics"])
def test_plans_stay_on_the_jvm(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
