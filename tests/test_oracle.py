"""Every query of the library beside its SQL; the corpus operators have tests of their own."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry
from crossblock.plans import oracle
from crossblock.plans import queries as registry

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# Tiny pools cannot form blocks, so the build needs more facts than the smallest scale has.
BUILT = {"c2_pair_facts", "c11_template_assignment", "l2_build_cells", "l2_build_dataset",
         "l3_measured_behavior", "l5_behavior_likelihood", "d12_pool_sizes"}
QUERIES, ORACLE = registry.REGISTRY, oracle.queries()


@pytest.fixture(scope="module")
def connections():
    return {sf: connect(sf) for sf in (SMALL, MEDIUM)}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connections, name):
    sf = MEDIUM if name in BUILT else SMALL
    df = QUERIES[name](spark, sf)
    assert compare(df, connections[sf], ORACLE[name]) == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 1
