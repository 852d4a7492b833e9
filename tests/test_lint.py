"""Quality checks of vocabularies on small graphs."""

from shapeforge.operators import lint
from shapeforge.operators.graphs import TYPE

COLS = "graph_id string, s string, p string, o string"


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), COLS)


def test_single_declaration_counts_names_over_all_graphs(spark):
    one = facts(spark, ("g", "a", TYPE, "Onto"), ("h", "a", TYPE, "Onto"), ("h", "b", TYPE, "Other"))
    two = one.unionByName(facts(spark, ("k", "c", TYPE, "Onto")))
    row = lambda df, *a: tuple(lint.single_declaration(df, "Onto", *a).first())
    assert row(one) == row(one, "a") == (1, "a", "a", True)
    assert row(one, "z") == (1, "a", "a", False)
    assert row(two, "a") == (2, "a", "c", False)
    assert row(one.where("o = 'Other'")) == row(one.limit(0), "a") == (0, None, None, False)
    assert sorted(r.s for r in lint.declared(two, "Onto").collect()) == ["a", "c"]


def test_blank_and_missing_annotations(spark):
    df = facts(spark, ("g", "a", TYPE, "C"), ("g", "b", TYPE, "C"), ("g", "c", TYPE, "C"), ("g", "a", "label", "x"), ("g", "b", "label", "  "), ("h", "c", "label", "x"))
    assert sorted(r.s for r in lint.missing_annotation(df, "C", "label").collect()) == ["b", "c"]


def test_foreign_and_invalid_terms(spark):
    df = facts(spark, ("g", "urn:n#Good", TYPE, "C"), ("g", "urn:n#Not good", TYPE, "C"), ("g", "urn:m#Good", TYPE, "C"), ("g", "urn:m#Else", TYPE, "D"))
    assert {(r.s, r.reason) for r in lint.foreign_terms(df, ["C"], "urn:n#").collect()} == {("urn:n#Not good", "invalid-local-name"), ("urn:m#Good", "foreign-namespace")}
