"""Every registered query of the engine against its SQL."""

import pytest
from conftest import same_rows

from concordia import registry

SLOW = {"bench_rollup", "bench_tokens"}


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - SLOW))
def test_query_matches_sql(name, spark, sf, duck):
    assert same_rows(registry.queries()[name](spark, sf), duck.execute(registry.oracle_sql()[name]).df())


def test_benchmark_reproduces_the_published_means(spark, sf, duck):
    assert same_rows(registry.queries()["bench_rollup"](spark, sf), duck.execute(registry.oracle_sql()["bench_rollup"]).df())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_in_relational_plans(spark, sf):
    for name in ("slot_decisions_lineitem", "heuristic_merge", "derivation_status", "claims_bag", "redacted_text"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan, name


def test_scan_reads_only_needed_columns(spark, sf):
    plan = registry.queries()["slot_decisions_lineitem"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan
