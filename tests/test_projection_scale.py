"""Documents are projected row by row; only those that may say something twice are shuffled."""

import re

import pytest
from shapeforge.operators import conform, project
from shapeforge.plans import stand_ins as st
from shapeforge.plans.queries import QUERIES
from shapeforge.sources import shred

HEAD = ("doc_id", "kind", "depth", "local_name", "path", "bare_path")
ROW = ("parent_path", "attrs", "own_id", "up_id", "again", "alike", "n_children", "text")
DOCS = {
    "plain": (b'<Report id="r"><Form>F1</Form><Line n="1"><Flag>N</Flag></Line><Line n="2"><Flag>N</Flag></Line><Line/></Report>', False),
    "again": (b"<Report><Date>d</Date><Date>d</Date><Date>e</Date><Date/><Date/><Line><Flag>x</Flag><Flag>x</Flag></Line></Report>", False),
    "shared": (b'<Report id="r"><Line id="a" n="1"/><Line id="a" n="1"/></Report>', True),
    "both": (b'<Report Form="F1" id=""><Form>F1</Form></Report>', True),
    "spaces": (b'<Report xmlns:a="urn:a" xmlns:b="urn:b" a:k="1" b:k="1"><Form/></Report>', True),
    "hash": (b'<Report id="0123abc"><Form>F1</Form></Report>', True),
    "parent": (b'<Report id="z"><Extra><Form>F1</Form></Extra><Line id="q"><Flag>N</Flag></Line></Report>', False),
    "bad": (b"<Report>", None),
}


def _typed(spark, docs, columns):
    rows = shred.shredded(docs, (*HEAD, *columns)).where("kind = 'element'").drop("kind")
    return conform.typed_elements(rows, st.declarations(spark), max_depth=2)


def _shuffled(df):
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_facts_by_row_are_those_of_the_joins(spark):
    docs = spark.createDataFrame([(k, v) for k, (v, _) in DOCS.items()], "doc_id string, content binary")
    key = ["graph_id", "s", "p", "o", "o_kind", "o_datatype"]
    whole = shred.shredded(docs, ("doc_id", "kind", "seq", "attrs"))
    want = project.project_instances(_typed(spark, docs, ("seq", "parent_seq", "line", "col", "n_children", "text")), shred.attributes(whole))
    plain = project.project_instances(_typed(spark, docs, ROW).where("not alike"), once=True)
    rest = project.project_instances(_typed(spark, shred.alike(docs), ROW))
    assert sorted(map(str, plain.unionByName(rest).select(key).collect())) == sorted(map(str, want.select(key).collect()))
    assert {r.doc_id for r in shred.alike(docs).collect()} == {k for k, (_, same) in DOCS.items() if same}
    assert not [x for x in _shuffled(plain) if "schema_path" not in x]


@pytest.mark.parametrize("columns", [("seq", "own_id", "up_id", "again", "alike"), ("seq", "own_id", "up_id", "again", "alike", "line")])
def test_sameness_of_rows(spark, columns):
    docs = spark.createDataFrame([(k, v) for k, (v, _) in DOCS.items() if k in ("again", "parent")], "doc_id string, content binary")
    rows = shred.shredded(docs, ("doc_id", *columns)).orderBy("doc_id", "seq").collect()
    assert [r.seq for r in rows if r.again] == [2, 5, 8] and not any(r.alike for r in rows)
    assert [(r.own_id, r.up_id) for r in rows if r.doc_id == "parent"] == [("z", None), (None, "z"), (None, None), ("q", "z"), (None, "q")]


def test_the_query_shuffles_no_triples_of_plain_documents(spark):
    keys = _shuffled(QUERIES["prj_instances"](spark, "/root/testdata/sf0.001"))
    # the one shuffle of triples is that of the documents that the filter before it lets through
    assert len([x for x in keys if "o_datatype" in x]) == 1 and not [x for x in keys if "seq" in x]
