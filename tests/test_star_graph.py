"""The star graph's facts are distinct without a shuffle of triples, and the queries on it read it once where once is enough."""

from shapeforge.operators import graphs
from shapeforge.plans import stand_ins as st
from shapeforge.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_facts_are_distinct_and_never_shuffled(spark):
    triples = st.star_graph(spark, DATA)
    assert triples.count() == triples.distinct().count()
    plan = triples._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Aggregate") and "o_kind" in x]


def test_focus_counts_in_one_pass(spark):
    t = "graph_id string, s string, p string, o string"
    triples = spark.createDataFrame([("g", "a", graphs.TYPE, "C"), ("g", "a", graphs.TYPE, "C"), ("g", "b", graphs.TYPE, "D"), ("h", "a", "p", "C")], t)
    out = graphs.focus_count_check(triples, "C")
    assert {tuple(r) for r in out.collect()} == {("g", 1, True), ("h", 0, False)}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_shape_queries_keep_no_copy_of_the_triples(spark):
    spark.catalog.clearCache()
    plan = QUERIES["shp_conforms"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in QUERIES["shp_conforms"](spark, DATA)._jdf.queryExecution().withCachedData().toString() and "Join" in plan
