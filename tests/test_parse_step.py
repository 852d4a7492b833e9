"""The parse step that the document queries share: only what is asked for is made, counts of children need no shuffle."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from shapeforge.operators import conform
from shapeforge.plans import stand_ins as st
from shapeforge.sources import shred

DOCS = {"a": b"<Report><Form>F1</Form>\n<Line><Flag>N</Flag></Line><Line/></Report>", "bad": b"<Report>", "empty": None}


def _docs(spark):
    return spark.createDataFrame(list(DOCS.items()), "doc_id string, content binary")


def test_columns_asked_for(spark):
    rows = shred.shredded(_docs(spark), ("doc_id", "kind", "bare_path", "children", "line"))
    assert rows.columns == ["doc_id", "kind", "bare_path", "children", "line"]
    got = [(r.bare_path, r.line, [(c.name, c.n) for c in r.children]) for r in rows.where("kind = 'element'").collect()]
    assert got == [("/Report", 1, [("Form", 1), ("Line", 2)]), ("/Report/Form", 1, []), ("/Report/Line", 2, [("Flag", 1)]), ("/Report/Line/Flag", 2, []), ("/Report/Line", 2, [])]


def test_unparsed_are_the_error_rows(spark):
    whole, alone = shred.parse_findings(shred.shredded(_docs(spark))), shred.parse_findings(shred.unparsed(_docs(spark)))
    assert sorted(whole.collect()) == sorted(alone.collect()) and alone.count() == 2


def test_counts_of_children_shuffle_no_elements(spark):
    typed = conform.typed_elements(shred.elements(shred.shredded(_docs(spark))), st.declarations(spark), max_depth=2)
    decl = st.declarations(spark)
    for check in (conform.missing_elements, conform.too_many_elements, conform.choice_violations):
        plan = check(typed, decl)._jdf.queryExecution().optimizedPlan().toString()
        above = plan.split("MapInArrow")[0].splitlines()
        # an aggregate or a window over elements would stand above the parser
        chain = [x for x in above if x.lstrip(" :+-").startswith(("Aggregate", "Window")) and "doc_id" in x]
        assert not chain, plan
    got = {(r.data_location, r.message) for r in conform.missing_elements(typed, decl).collect()}
    assert ("/Report[1]", "Missing element Status") in got and ("/Report[1]/Line[1]", "Missing element Part") in got and ("/Report[1]/Line[2]", "Missing element Flag") in got
    assert [(r.data_location, r.observed_value) for r in conform.choice_violations(typed, decl).select(F.col("data_location"), "observed_value").collect()] == [("/Report[1]", "0")]


def test_documents_are_dealt_by_count(spark, monkeypatch):
    monkeypatch.setattr(st, "TASK_ORDERS", 100)
    docs = st.order_documents(spark, "/root/testdata/sf0.001")
    assert docs.rdd.getNumPartitions() == -(-st.table(spark, "/root/testdata/sf0.001", "orders").count() // 100)


ODD = [
    b"<a>x<!--c-->y<b/>z<?p q?>w</a>", b"<a><![CDATA[<&]]>&amp;&#65;</a>", b'<!DOCTYPE a [<!ENTITY e "v<b>w</b>"><!ATTLIST a k CDATA "d">]><a>&e;&e;</a>', b'<!DOCTYPE a SYSTEM "x"><a>&gone;<b/></a>',
    b'<p:a xmlns:p="urn:p" xmlns="urn:d" p:k="1" j="2"><b/><p:b/><b xmlns=""/></p:a>', b"<a>", b"", b"<a/><b/>", b"<q:a/>", '<?xml version="1.0" encoding="iso-8859-1"?><a k="é">é</a>'.encode("latin-1"), b"<a>\r\n<b>\t</b></a>\n", b"<a>\xff</a>",
    b"<d>" * 300 + b"</d>" * 300,
]


def _random_document(rng, depth=0):
    name, n = rng.choice("abc"), rng.randint(0, 3) if depth < 4 else 0
    return f"<{name}{rng.choice(['', ' k=\"1\"'])}>{rng.choice(['', 't', ' '])}" + "".join(_random_document(rng, depth + 1) + rng.choice(["", "u"]) for _ in range(n)) + f"</{name}>"


@pytest.mark.parametrize("kept, chunk", [(100_000, 20_000), (5, 3)])
def test_trees_give_the_rows_of_the_events(monkeypatch, kept, chunk):
    monkeypatch.setattr(shred, "_KEPT", kept)
    monkeypatch.setattr(shred, "_CHUNK", chunk)
    rng = random.Random(5)
    docs = [*ODD, None, *(_random_document(rng).encode() for _ in range(300)), *ODD]
    batches = [pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(at, min(at + 100, len(docs)))]), pa.array(docs[at : at + 100], pa.binary())], names=["doc_id", "content"]) for at in range(0, len(docs), 100)]
    columns = tuple(c for c in shred._KINDS if c in shred._OF_TREES)
    rows = lambda parser: sorted((r for b in parser(columns)(iter(batches)) for r in b.to_pylist()), key=lambda r: (int(r["doc_id"]), r["seq"] or 0))
    want, got = rows(shred._parser_of), rows(shred._tree_parser_of)
    assert got == want and len(got) > 3000
    for some in (("doc_id", "kind"), ("doc_id", "kind", "attrs"), ("doc_id", "text", "seq")):
        assert [b.schema.names for b in shred._tree_parser_of(some)(iter(batches))][0] == list(some)


def test_rows_of_a_form_are_made_once(monkeypatch):
    made = []
    monkeypatch.setattr(shred, "_shape_rows", lambda cols, tags, sizes, real=shred._shape_rows: (made.append(tags), real(cols, tags, sizes)))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(1000)]), pa.array([f"<a><b>{i}</b></a>".encode() for i in range(1000)])], names=["doc_id", "content"])
    out = list(shred._tree_parser_of(("doc_id", "kind", "path", "text"))([batch]))
    assert made == [["a", "b"]] and sum(b.num_rows for b in out) == 2000
    assert out[-1].to_pylist()[-1] == {"doc_id": "999", "kind": "element", "path": "/a[1]/b[1]", "text": "999"}


def test_checks_look_only_at_the_types_there_are(spark):
    rows = spark.createDataFrame([(k, v) for k in ("Count", "Date", "Year", "Other", None) for v in ("1", "x", "2024-02-30", "99999999999999999999", None)], "k string, v string")
    kinds = {"Count", "Date", "Year", "Other"}
    short, full = conform.is_lexical(F.col("k"), F.col("v"), kinds), conform.is_lexical(F.col("k"), F.col("v"))
    assert rows.where(~short.eqNullSafe(full)).count() == 0
    plan = lambda c: rows.where(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "gYear" not in plan(short) and len(plan(short)) < len(plan(full)) / 3
    facet = conform.breaks_facet(F.col("k"), F.lit("2"), F.col("v"), {"maxLength"})
    assert "totalDigits" not in plan(facet) and "maxLength" in plan(facet)


def test_missing_elements_are_looked_up_not_searched(spark):
    typed = conform.typed_elements(shred.elements(shred.shredded(_docs(spark))), st.declarations(spark), max_depth=2)
    for check in (conform.missing_elements, conform.too_many_elements):
        assert "lambda" not in check(typed, st.declarations(spark))._jdf.queryExecution().optimizedPlan().toString()
