import pytest
from pyspark.sql import functions as F

from shapeforge.functions import strings as S
from shapeforge.sources import documents as src
from shapeforge.sources import shred


def column(spark, values, f):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r.x for r in spark.createDataFrame(rows, "i int, v string").select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "f, given, want",
    [
        (S.local_name_from_text, ["C3", "Accessory Dwelling Unit", "123", " \n a-b\t", "  ", None], ["C3", "Accessory_Dwelling_Unit", "_123", "a_b", None, None]),
        (S.local_name_from_arcrole, ["urn:x:A_Is_B", "http://h/p#q/", "a/b#c:d e", "9"], ["A_Is_B", "q", "d_e", "_9"]),
        (S.strip_type_suffix, ["SubjectPropertyType", "TypeType", "Typed"], ["SubjectProperty", "Type", "Typed"]),
        (S.strip_prefix, ["a:b:c", "plain", "", None], ["b:c", "plain", None, None]),
        (S.is_valid_local_name, ["_a1", "1a", "a-b", "a\n", ""], [True, False, False, False, False]),
        (S.mint_term_iri, ["Ok", "not ok"], ["https://example.org/reports/ontology#Ok", None]),
        (S.with_fragment_separator, ["urn:a", "urn:a#", "urn:a/"], ["urn:a#", "urn:a#", "urn:a/"]),
        (S.local_name, ["{urn:a}b", "a:b:c", "plain"], ["b", "c", "plain"]),
        (S.normalize_path, ["/{http://x/y}A/b:C[2]", "A", "", None, "///"], ["/A[1]/C[2]", "/A[1]", "", "", ""]),
        (S.label_from_local_name, ["a_b_c"], ["a b c"]),
    ],
)
def test_names(spark, f, given, want):
    assert column(spark, given, f) == want


def test_paths_and_iris(spark):
    assert column(spark, ["/A[1]/B[2]", ""], S.ancestor_paths) == [["/A[1]/B[2]", "/A[1]"], []]
    assert column(spark, [" a b/c#d*e~f+g ", "  "], lambda c: S.mint_path_iri(F.lit("x"), c, base="b/")) == ["b/x/a_b/c#d%2Ae~f%2Bg", "b/x"]
    texts = spark.createDataFrame([(["  a ", "", "b"],), ([" "],)], "t array<string>")
    assert [r.x for r in texts.select(S.documentation_text(F.col("t")).alias("x")).collect()] == ["a\n\nb", None]


XML = {
    "valid": "<Appraisal>\n  <Identifier>APP-001</Identifier>\n</Appraisal>",
    "cut": "<Appraisal>\n  <Identifier>APP-001</Identifier>\n",
    "ns": '<?xml version="1.0"?>\n<a:A xmlns:a="urn:x/y" k="1"><a:B/>é<a:B z="2">t<c/>u</a:B></a:A>',
    "text": "not xml",
    "none": None,
}


def rows(spark, docs):
    return shred.shredded(spark.createDataFrame([(k, v.encode() if v is not None else None) for k, v in docs.items()], "doc_id string, content binary")).persist()


def test_shredding(spark):
    r = rows(spark, XML)
    e = {(x.doc_id, x.path): x for x in shred.elements(r).collect()}
    assert e["valid", "/Appraisal[1]/Identifier[1]"].line == 2 and e["valid", "/Appraisal[1]/Identifier[1]"].col == 3
    b = e["ns", "/A[1]/B[2]"]
    assert (b.ns, b.local_name, b.sibling_index, b.text, b.n_children, b.depth, b.parent_seq) == ("urn:x/y", "B", 2, "tu", 1, 1, 0)
    assert {(a.seq, a.name, a.value) for a in shred.attributes(r).where("doc_id = 'ns'").collect()} == {(0, "k", "1"), (2, "z", "2")}
    bad = {x.doc_id: x for x in shred.parse_findings(r).collect()}
    assert set(bad) == {"cut", "text", "none"} and (bad["cut"].line, bad["cut"].col) == (3, 1)


def test_unreadable_packages(spark):
    rows = [("a", "<x/>", None), ("b", "  \n<x/>", "first"), ("c", "text", "second"), ("d", "", None), ("e", None, None)]
    packs = src.packages_from_table(spark.createDataFrame(rows, "id string, t string, s string"), "id", "t", scope_col="s")
    got = {r.doc_id: r for r in shred.unreadable_packages(packs).collect()}
    assert set(got) == {"c", "d", "e"} and got["c"].investor == "second" and got["d"].investor == "both"
    assert got["c"].data_location == "/" and not got["c"].requires_human_review


def test_files_and_triples_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("b.xsd", "A.XSD", "c.txt"):
        (tmp_path / "in" / name).write_text("<a/>")
    assert [r.file for r in src.read_schema_files(spark, str(tmp_path / "in")).collect()] == ["A.XSD", "b.xsd"]
    assert {r.package_name for r in src.read_documents(spark, str(tmp_path / "in")).collect()} == {"A.XSD", "b.xsd", "c.txt"}
    triples = [("urn:s", "urn:p", 'a "b"\n\\n', "literal", None, None), ("urn:s", "urn:p", "1", "literal", "urn:int", None), ("urn:s", "urn:p", "x", "literal", None, "en"), ("urn:s", "urn:p", "urn:o", "iri", None, None)]
    df = spark.createDataFrame(triples, "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    src.write_triples(df, str(tmp_path / "out"))
    back = src.read_triples(spark, str(tmp_path / "out"))
    assert {tuple(r)[1:] for r in back.collect()} == set(triples)
    lines = spark.createDataFrame([("g1", "_:a <urn:p> _:b ."), ("g2", "_:a <urn:p> _:b ."), ("g1", "# no")], "graph_id string, value string")
    assert {r.s for r in src.parse_ntriples(lines).collect()} == {"urn:bnode:g1:a", "urn:bnode:g2:a"}


def test_reports_and_profiles(spark, tmp_path):
    reports = spark.createDataFrame([("a", "passed"), ("b", "failed")], "doc_id string, status string")
    found = spark.createDataFrame([("b", "error", "m2", 9, 1, "x", "/"), ("b", "error", "m1", 2, 1, "x", "/")], "doc_id string, severity string, message string, line int, col int, error_code string, data_location string")
    got = {r.doc_id: [f.message for f in r.findings] for r in src.nested_reports(reports, found).collect()}
    assert got == {"a": [], "b": ["m1", "m2"]}
    src.write_reports(reports, found, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    profile = spark.createDataFrame([("f.xsd", 2, "xs", [("a", "1")], ["element"])], "file string, line_number int, prefix string, attributes array<struct<name:string,value:string>>, constructs array<string>")
    src.write_component_profiles(profile, str(tmp_path / "p"))
    assert 'a="1"' in "\n".join(r.value for r in spark.read.text(str(tmp_path / "p")).collect())
