"""The registered queries run over whole tables."""

import os

import pytest

from statuta.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def ids(spark, table, column, prefix):
    return {f"{prefix}{r[0]}" for r in spark.read.parquet(f"{SF}/{table}.parquet").select(column).collect()}


def test_every_customer_supplier_and_nation_is_in_the_graph_and_hit(spark):
    whole = ids(spark, "customer", "c_custkey", "C") | ids(spark, "supplier", "s_suppkey", "S") | ids(spark, "nation", "n_nationkey", "N")
    assert whole <= {r.id for r in registry.queries()["static_nodes"](spark, SF).collect()}
    assert whole <= {r.node_id for r in registry.queries()["anchors"](spark, SF).collect()}


def test_all_arms_of_the_experiment_meet_long_texts(spark):
    arms = {r.experiment: r.n_chunks for r in registry.queries()["experiment_arms"](spark, SF).collect()}
    assert len(arms) == 13 and "semantic_sim74" in arms
    assert arms["simple_128_ov16"] > arms["simple_256_ov16"] > arms["simple_512_ov16"]
    assert set(arms) == {r.experiment for r in registry.queries()["experiment_summary"](spark, SF).collect()}
