import pytest
from pyspark.sql import functions as F

from shapeforge.operators import conform, findings, schema, vocab
from shapeforge.schemas import XSD_NS
from shapeforge.sources import shred
from shapeforge.streaming import intake

DECL = '<?xml version="1.0" encoding="UTF-8"?>\n'
XS = f'xmlns:xs="{XSD_NS}"'
HEADERS = {
    "ok": (DECL + f'<!-- a\n b -->\n\n  <xs:schema {XS} version="1"  a=\'2\'>\n', None, 5),
    "declaration": ("\n" + DECL, "xml-declaration", None),
    "blank": (DECL.replace(" ?", "?").replace("\n", " \n") + f"<xs:schema {XS}>", "xml-declaration", None),
    "open": (DECL + "<!-- never closed", "open-comment", None),
    "nothing": (DECL + "\n  \n", "no-schema-element", None),
    "prefix": (DECL + f"<schema {XS}>", "schema-prefix", None),
    "other": (DECL + f"<xs:element {XS}>", "schema-prefix", None),
    "unbound": (DECL + '<xs:schema xmlns:xs="urn:x">', "namespace-not-bound", None),
    "both": (DECL + f'<xs:schema {XS} xmlns:xsd="{XSD_NS}">', "namespace-ambiguous", None),
    "mismatch": (DECL + f"<xsd:schema {XS}>", "prefix-mismatch", None),
}


def test_headers(spark):
    files = spark.createDataFrame([(k, v[0]) for k, v in HEADERS.items()], "file string, text string")
    got = {r.file: r for r in schema.schema_headers(files).collect()}
    assert {k: (r.error_code, r.line_number) for k, r in got.items()} == {k: v[1:] for k, v in HEADERS.items()}
    assert [(a.name, a.value) for a in got["ok"].attributes] == [("xmlns:xs", XSD_NS), ("version", "1"), ("a", "2")]


XSD_TEXT = f"""<xs:schema {XS} targetNamespace="urn:t">
<xs:simpleType name="ConditionRatingType"><xs:restriction base="xs:string"><xs:enumeration value="C1"><xs:annotation><xs:documentation> first </xs:documentation></xs:annotation></xs:enumeration><xs:enumeration value="C2"/></xs:restriction></xs:simpleType>
<xs:complexType name="SubjectPropertyType"><xs:complexContent><xs:extension base="m:PropertyType"/></xs:complexContent></xs:complexType>
<xs:element name="Address" type="t:SubjectPropertyType"/></xs:schema>"""


def test_vocabularies(spark):
    rows = shred.shredded(spark.createDataFrame([("f", XSD_TEXT.encode())], "doc_id string, content binary")).persist()
    els, attrs = shred.elements(rows), shred.attributes(rows)
    values = {(r.scheme_local_name, r.value_local_name): r.doc for r in vocab.enumerations(els, attrs).collect()}
    assert values == {("ConditionRating", "C1"): "first", ("ConditionRating", "C2"): None}
    assert [tuple(r)[1:] for r in vocab.complex_types(els, attrs).collect()] == [("SubjectPropertyType", "SubjectProperty", None, "PropertyType")]
    triples = {(r.s, r.p.split("#")[1], r.o.split("#")[1]) for r in vocab.schema_triples(els, attrs).collect()}
    assert triples == {("urn:t#SubjectPropertyType", "type", "Class"), ("urn:t#Address", "type", "ObjectProperty"), ("urn:t#Address", "range", "SubjectPropertyType")}
    kept = vocab.complex_type_triples(vocab.complex_types(els, attrs).withColumn("graph_id", F.col("doc_id")), subclass=False)
    assert not kept.where("p like '%subClassOf'").count()
    c = {(r.construct, r.name): r.owner for r in schema.schema_components(els, attrs).collect()}
    assert c["enumeration", "C1"] == "ConditionRatingType" and c["element", "Address"] is None
    assert schema.component_profile(els).first().constructs[0] == "annotation"


@pytest.mark.parametrize(
    "kind, good, bad",
    [
        ("Amount", ["1", "-1.50", "+.5"], ["", "1,0", " 1", "1e3"]), ("Count", ["0", "12"], ["-1", "1.0", "99999999999"]), ("Year", ["1", "9999"], ["0", "10000"]),
        ("Date", ["2024", "2024-02", "2024-02-29"], ["2023-02-29", "2024-13", "24", "2024-1-1"]), ("Indicator", ["true"], ["1", "TRUE"]), ("Datetime", ["2024-01-01T00:00:00.123456789Z"], ["2024-01-01T00:00:00", "2024-01-01"]),
        ("NumericString", ["", "012"], ["1a"]), ("Month", ["--12"], ["--13"]), ("Time", ["23:59:59", "24:00:00"], ["24:00:01"]), ("Enum", ["x" * 80], ["x" * 81]),
    ],
)
def test_lexical_spaces(spark, kind, good, bad):
    rows = [(kind, v, True) for v in good] + [(kind, v, False) for v in bad]
    got = spark.createDataFrame(rows, "k string, v string, want boolean").withColumn("got", conform.is_lexical(F.col("k"), F.col("v")))
    assert got.where("got is null or got <> want").count() == 0


def test_structure_of_small_documents(spark):
    decl = spark.createDataFrame([("#root", "Appraisal", "A", 1, 1, 1, None, None, None), ("A", "Identifier", "String", 1, 1, 1, None, None, None)], "owner string, name string, type_ref string, pos int, min_occurs int, max_occurs int, fixed string, choice_id string, branch string")
    docs = {"ok": "<Appraisal>\n<Identifier>1</Identifier></Appraisal>", "bad": "<Appraisal>\n<X/><Y><Z/></Y>\n</Appraisal>", "root": "<Invoice><Identifier/></Invoice>"}
    rows = shred.shredded(spark.createDataFrame([(k, v.encode()) for k, v in docs.items()], "doc_id string, content binary")).persist()
    els = shred.elements(rows)
    typed = conform.typed_elements(els, decl)
    unknown = {(r.doc_id, r.data_location) for r in conform.unknown_elements(typed).collect()}
    assert unknown == {("bad", "/Appraisal[1]/X[1]"), ("bad", "/Appraisal[1]/Y[1]"), ("root", "/Invoice[1]")}
    missing = conform.missing_elements(typed, decl)
    assert [(r.doc_id, r.data_location) for r in missing.collect()] == [("bad", "/Appraisal[1]")]
    ghost = missing.withColumn("data_location", F.lit("/Appraisal/Identifier/Deep[3]"))
    at = conform.locate_findings(ghost, els).first()
    assert (at.line, at.col) == (1, 1)
    packs = spark.createDataFrame([(k, k) for k in docs], "doc_id string, package_name string")
    reports = {r.doc_id: r for r in findings.schema_reports(packs, conform.unknown_elements(typed)).collect()}
    assert reports["ok"].status == "passed" and reports["bad"].error_count == 2 and sum(r.finding_count for r in reports.values()) == 3


def test_streams_equal_batches(spark, tmp_path):
    rows = [(f"f{i % 6}", "2024-01-01 00:%02d:00" % i, ["info", "error"][i % 2]) for i in range(12)]
    df = spark.createDataFrame(rows, "finding_id string, t string, severity string").withColumn("created_at", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    once = stream.withWatermark("created_at", "1 hour").dropDuplicatesWithinWatermark(["finding_id"])
    got = intake.run_available(once, "once", str(tmp_path / "c1"))
    assert got.count() == 6
    counted = intake.run_available(intake.stream_severity_counts(stream.drop("t")), "counted", str(tmp_path / "c2"), "update")
    assert {(r.info, r.error) for r in counted.collect()} == {(3, 3)}
    packs = spark.createDataFrame([("a", "<x/>"), ("b", "text")], "doc_id string, xml_text string")
    packs.write.parquet(str(tmp_path / "p"))
    found = intake.run_available(intake.stream_packages(spark.readStream.schema(packs.schema).parquet(str(tmp_path / "p"))), "packs", str(tmp_path / "c3"))
    assert [r.doc_id for r in found.collect()] == ["b"]


def test_order_looks_at_all_siblings_before_and_facets_at_dates(spark):
    docs = spark.createDataFrame([("d", b"<R><C/><A/><B/><D>2019-01-01</D></R>")], "doc_id string, content binary")
    decl = [("#root", "R", "RT", 1), ("RT", "A", "String", 1), ("RT", "B", "String", 2), ("RT", "C", "String", 3), ("RT", "D", "date", 4)]
    decl = spark.createDataFrame([(o, n, t, p, 1, 1, None, "ch" if n == "B" else None, None) for o, n, t, p in decl], "owner string, name string, type_ref string, pos int, min_occurs int, max_occurs int, fixed string, choice_id string, branch string")
    typed = conform.typed_elements(shred.elements(shred.shredded(docs)), decl)
    assert {r.observed_value for r in conform.order_violations(typed, decl).collect()} == {"A after C", "B after C"}
    facets = spark.createDataFrame([("date", "minInclusive", "2020-01-01"), ("date", "maxInclusive", "2020-01-01")], "type_ref string, facet string, limit string")
    assert [r.expected_condition for r in conform.facet_violations(typed, facets).collect()] == ["minInclusive 2020-01-01"]


def test_components_keep_prefixes_for_properties_and_shapes(spark):
    xsd = b'<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema"><xsd:complexType name="T"><xsd:sequence><xsd:element name="n" type="xsd:int"/></xsd:sequence></xsd:complexType></xsd:schema>'
    rows = shred.shredded(spark.createDataFrame([("f", xsd)], "doc_id string, content binary"))
    parts = schema.schema_components(shred.elements(rows), shred.attributes(rows))
    assert {r.range for r in vocab.refine_properties(parts).collect()} == {"http://www.w3.org/2001/XMLSchema#int"}
    assert ("datatype", "http://www.w3.org/2001/XMLSchema#int") in {(r.kind, r.value) for r in vocab.structural_shapes(parts).collect()}
