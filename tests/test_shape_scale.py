"""Shape validation shuffles no triples that come dealt by graph, node shapes follow failures only."""

import re

from shapeforge.operators import graphs, shapes
from shapeforge.plans import stand_ins as st

DATA = "/root/testdata/sf0.001"
TRIPLE = "graph_id string, s string, p string, o string, o_kind string, o_datatype string, o_lang string"
SHAPE = "shape string, target_class string, path string, kind string, value string, severity string"


def _triples(spark, facts):
    return spark.createDataFrame([("g", s, p, o, kind, None, None) for s, p, o, kind in facts], TRIPLE)


def test_rounds_of_node_shapes_hold_failures_only(spark, monkeypatch):
    starts = []
    real = shapes.grown
    monkeypatch.setattr(shapes, "grown", lambda start, *rest: (starts.append(start.count()), real(start, *rest))[1])
    # a chain and a ring, each once well and once with a bad end; c9 is bad too, but no path leads from a target to it
    facts = [("a0", graphs.TYPE, "Start", "iri"), ("b0", graphs.TYPE, "Start", "iri")]
    facts += [(f"{x}{i}", "next", f"{x}{i + 1}", "iri") for x in "ab" for i in range(4)] + [("a4", "size", "1", "literal"), ("c8", "next", "c9", "iri")]
    facts += [(f"r{i}", "peer", f"r{(i + 1) % 3}", "iri") for i in range(3)] + [("r0", graphs.TYPE, "Ring", "iri")]
    rows = [("S", "Start", "next", "node", "T", "violation"), ("T", "none", "next", "node", "T", "violation"), ("T", "none", "size", "maxLength", "1", "violation"), ("R", "Ring", "peer", "node", "R", "warning"), ("R", "Ring", "peer", "minCount", "1", "violation")]
    rows += [("T", "none", "size", "in", "1", "violation")]
    table = spark.createDataFrame(rows, SHAPE)
    none = spark.createDataFrame([], TRIPLE)
    assert shapes.validate_shapes(_triples(spark, facts), table, none).collect() == [] and starts == [0]
    starts.clear()
    bad = facts + [("b4", "size", "22", "literal"), ("c9", "size", "3", "literal")]
    got = {(r.focus, r.component, r.value) for r in shapes.validate_shapes(_triples(spark, bad), table, none).collect()}
    assert got == {("b0", "node", "b1")} and starts[0] <= 4


def test_graphs_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(st, "TASK_ORDERS", 100)
    n = -(-st.table(spark, DATA, "orders").count() // 100)
    assert st.nested_graph(spark, DATA, by_graph=True).rdd.getNumPartitions() == n


def _shuffles(df):
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_triples_dealt_by_graph_are_not_shuffled(spark):
    ontology, rows = st.ontology(spark), st.shapes(spark)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        triples = st.star_graph(spark, DATA, by_graph=True)
        results = shapes.validate_shapes(triples, rows, ontology)
        defects = shapes.classify_defects(results, triples, rows, graphs.subclass_closure(ontology))
        verdicts = shapes.conforms(triples.where(f"o = '{st.T}Appraisal'"), results)
        for made in (results, defects, verdicts):
            # orders meet their customers and rows are dealt by graph; nothing else is
            assert all(re.fullmatch(r"(o_custkey|c_custkey|graph_id)#\w+, \d+", keys) for keys in _shuffles(made)), _shuffles(made)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    want = shapes.validate_shapes(st.star_graph(spark, DATA), rows, ontology)
    assert sorted(map(str, results.collect())) == sorted(map(str, want.collect()))


def test_null_values_meet_nothing(spark):
    rows = spark.createDataFrame([("g", "a", 1), ("g", None, 2), ("h", "a", 3)], "graph_id string, value string, n int")
    marks = spark.createDataFrame([("g", "a"), ("g", "a"), ("g", None)], "graph_id string, value string")
    assert sorted((r.n, r.met) for r in shapes._met(rows, marks, ["graph_id", "value"]).collect()) == [(1, True), (2, False), (3, False)]
