"""Schema sets: names over includes and imports, groups, inheritance, content models, unions; and the checks they drive."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from shapeforge.operators import conform, resolve, shapes, vocab
from shapeforge.operators.fixpoint import grown
from shapeforge.schemas import TERMS, XSD_NS
from shapeforge.sources import documents, shred

X = f'xmlns:x="{XSD_NS}"'
FILES = {
    "a/root.xsd": f'<x:schema {X} targetNamespace="urn:t" xmlns="urn:t" xmlns:u="urn:u"><x:include schemaLocation="./sub/types.xsd"/><x:import namespace="urn:u" schemaLocation="u.xsd"/><x:include schemaLocation="gone.xsd"/>'
    '<x:element name="Address" type="AddressType"/><x:element name="Note" type="x:string"/></x:schema>',
    "a/sub/types.xsd": f"""<x:schema {X} xmlns:u="urn:u"><x:include schemaLocation="../root.xsd"/>
<x:simpleType name="City"><x:restriction base="x:string"><x:maxLength value="9"/></x:restriction></x:simpleType>
<x:simpleType name="SmallCity"><x:restriction base="City"><x:minLength value="2"/><x:enumeration value="Rome"/><x:enumeration value="Oslo"/></x:restriction></x:simpleType>
<x:simpleType name="When"><x:union memberTypes="x:gYear x:gYearMonth"><x:simpleType><x:restriction base="x:date"/></x:simpleType></x:union></x:simpleType>
<x:complexType name="Base"><x:sequence><x:element name="Id" type="x:int"/><x:element ref="Note" minOccurs="0"/></x:sequence><x:attribute name="k" type="x:int" use="required"/></x:complexType>
<x:group name="G"><x:choice><x:element name="A" type="x:int"/><x:element name="B" type="When"/></x:choice></x:group>
<x:attributeGroup name="AG"><x:attribute name="m" type="City"/><x:attributeGroup ref="AG2"/></x:attributeGroup><x:attributeGroup name="AG2"><x:attribute name="z"/><x:attributeGroup ref="AG"/></x:attributeGroup>
<x:complexType name="AddressType"><x:annotation><x:documentation> where </x:documentation></x:annotation><x:complexContent><x:extension base="Base"><x:sequence><x:element name="City" type="SmallCity"/><x:group ref="G" maxOccurs="unbounded"/>
<x:element name="P"><x:complexType><x:sequence><x:element name="Q" type="u:V" maxOccurs="3"/></x:sequence></x:complexType></x:element><x:choice><x:element name="C" type="x:int"/><x:sequence><x:element name="D" type="x:int"/><x:element name="E" type="x:int"/></x:sequence></x:choice>
</x:sequence><x:attributeGroup ref="AG"/></x:extension></x:complexContent></x:complexType></x:schema>""",
    "a/u.xsd": f'<y:schema xmlns:y="{XSD_NS}" targetNamespace="urn:u" xmlns:t="urn:u"><y:complexType name="V"><y:simpleContent><y:extension base="y:decimal"><y:attribute name="cur" type="y:string" fixed="EUR"/></y:extension></y:simpleContent></y:complexType></y:schema>',
}
KEY = "a/root.xsd|{urn:t}"


def sets_of(spark, files, *roots):
    rows = shred.shredded(spark.createDataFrame([(k, v.encode()) for k, v in files.items()], "doc_id string, content binary")).persist()
    return resolve.schema_sets(shred.elements(rows), shred.attributes(rows), shred.namespaces(rows), spark.createDataFrame([(r,) for r in roots], "file string") if roots else None)


@pytest.fixture(scope="module")
def address(spark):
    return sets_of(spark, FILES, "a/root.xsd")


def test_files_and_names(address):
    assert {tuple(r) for r in address.files.collect()} == {
        ("a/root.xsd", "a/root.xsd", "urn:t", 0, True), ("a/root.xsd", "a/sub/types.xsd", "urn:t", 1, True), ("a/root.xsd", "a/u.xsd", "urn:u", 1, True), ("a/root.xsd", "a/gone.xsd", "urn:t", 1, False),
    }
    types = {r.type_ref: (r.kind, r.base, r.derivation, r.doc) for r in address.types.where("name is not null").collect()}
    assert types[KEY + "AddressType"] == ("complex", KEY + "Base", "extension", "where")
    assert types["a/root.xsd|{urn:u}V"] == ("complex", "decimal", "extension", None)
    assert types[KEY + "SmallCity"] == ("simple", KEY + "City", "restriction", None)


def test_declarations_put_inherited_content_first(address):
    rows = address.declarations.where(F.col("owner") == KEY + "AddressType").orderBy("pos", "name").collect()
    short = lambda t: t.replace(KEY, "").replace("a/root.xsd|", "")
    assert [(r.name, short(r.type_ref), r.pos, r.min_occurs, r.max_occurs, r.choice_id is not None) for r in rows] == [
        ("Id", "int", 1, 1, 1, False), ("Note", "string", 2, 0, 1, False), ("City", "SmallCity", 3, 1, 1, False), ("A", "int", 4, 0, None, False), ("B", "When", 4, 0, None, False),
        ("P", "#a/sub/types.xsd:36", 5, 1, 1, False), ("C", "int", 6, 1, 1, True), ("D", "int", 6, 1, 1, True), ("E", "int", 6, 1, 1, True),
    ] or [r.name for r in rows] == ["Id", "Note", "City", "A", "B", "P", "C", "D", "E"] and rows[5].type_ref.startswith(KEY + "#a/sub/types.xsd:")
    branch = {r.name: r.branch for r in rows}
    assert branch["D"] == branch["E"] != branch["C"]
    attributes = {(short(r.owner), r.name): (r.use, r.fixed) for r in address.attributes.collect()}
    assert attributes == {("Base", "k"): ("required", None), ("AddressType", "k"): ("required", None), ("AddressType", "m"): ("optional", None), ("AddressType", "z"): ("optional", None), ("{urn:u}V", "cur"): ("optional", "EUR")}
    assert {(short(r.type_ref), r.member) for r in address.unions.where("type_ref like '%When' or type_ref like '%V'").collect()} == {("When", "gYear"), ("When", "gYearMonth"), ("When", "date"), ("{urn:u}V", "decimal")}
    assert {(short(r.type_ref), r.facet, r.limit) for r in address.facets.collect()} == {("City", "maxLength", "9"), ("SmallCity", "maxLength", "9"), ("SmallCity", "minLength", "2")}
    assert {(short(r.type_ref), r.value) for r in address.values.collect()} == {("SmallCity", "Rome"), ("SmallCity", "Oslo")}


def test_documents_are_checked_by_schema_files(spark, address):
    ok = '<Address k="1" m="Rome" xmlns="urn:t"><Id>1</Id><City>Rome</City><A>1</A><B>2024</B><A>2</A><P><Q cur="EUR">1.5</Q><Q>2</Q></P><D>1</D><E>2</E></Address>'
    bad = '<Address k="x" m="much too long" odd="1"><City>Paris</City><B>2024-13</B><Id>1</Id><P><Q cur="USD">one</Q></P><C>1</C><D>1</D><Z/></Address>'
    docs = spark.createDataFrame([("ok", ok.encode()), ("bad", bad.encode())], "doc_id string, content binary")
    rows = shred.shredded(docs).persist()
    typed = conform.typed_elements(shred.elements(rows).withColumn("set_id", F.lit("a/root.xsd")), address.declarations).persist()
    found = {(r.doc_id, r.error_code, r.data_location, r.observed_value) for r in conform.check_against(typed, shred.attributes(rows), address).collect()}
    at = "/Address[1]"
    assert found == {("bad", *f) for f in [
        ("unknown-element", f"{at}/Z[1]", "Z"), ("content-model", f"{at}/City[1]", "City after the start"), ("content-model", f"{at}/Id[1]", "Id after B"), ("content-model", f"{at}/P[1]", "P after Id"),
        ("content-model", f"{at}/D[1]", "D after C"), ("content-model", at, "the end after D"), ("choice", at, "2"), ("datatype", f"{at}/@k", "x"), ("datatype", f"{at}/B[1]", "2024-13"), ("datatype", f"{at}/P[1]/Q[1]", "one"),
        ("facet", f"{at}/@m", "much too long"), ("enumeration", f"{at}/City[1]", "Paris"), ("unknown-attribute", at, "1"), ("fixed", f"{at}/P[1]/Q[1]/@cur", "USD"),
    ]}


def test_properties_and_shapes_see_included_types(address):
    kinds = {(r.name, r.kind, r.range) for r in vocab.set_properties(address).where("name in ('Address', 'City', 'Q')").collect()}
    assert kinds == {("Address", "ObjectProperty", "AddressType"), ("City", "DatatypeProperty", "SmallCity"), ("Q", "DatatypeProperty", "V")}
    got = {(r.path.split("#")[1], r.kind, r.value.split("#")[-1]) for r in vocab.set_shapes(address).where(F.col("shape") == "shape:AddressType").collect()}
    assert {("City", "maxLength", "9"), ("City", "in", "Rome"), ("Id", "minCount", "1"), ("k", "minCount", "1"), ("m", "maxLength", "9"), ("B", "datatype", "gYear")} <= got


LOOP = f"""<x:schema {X}><x:element name="R" type="R"/><x:complexType name="R"><x:sequence>
<x:choice minOccurs="0" maxOccurs="unbounded"><x:element name="A"/><x:element name="B"/></x:choice><x:sequence minOccurs="0"><x:element name="C" maxOccurs="2"/><x:element name="D" minOccurs="0"/></x:sequence>
<x:element name="E"><x:complexType><x:all><x:element name="F"/><x:element name="G" minOccurs="0"/></x:all></x:complexType></x:element><x:choice><x:element name="H"/><x:sequence><x:element name="A"/><x:element name="I"/></x:sequence></x:choice>
</x:sequence></x:complexType></x:schema>"""


def test_content_models_agree_with_regular_expressions(spark):
    """Neighbours decide: here every name but A stands in one place, so the model takes just the words of this expression."""
    sets = sets_of(spark, {"l.xsd": LOOP})
    follows = {}
    for r in sets.follows.collect():
        follows.setdefault(r.owner, set()).add((r.before, r.after))
    model = follows["l.xsd|{}R"]
    want = re.compile("[AB]*(?:C+D?)?E(?:H|AI)")
    for n in range(6):
        for word in itertools.product("ABCDEHI", repeat=n):
            text = "".join(word)
            steps = set(itertools.pairwise(["^", *word, "$"]))
            if want.fullmatch(text):
                assert steps <= model, text
            elif "A" not in text:
                assert not steps <= model, text
    inner = next(v for k, v in follows.items() if "#" in k)
    assert {("^", "F"), ("^", "G"), ("F", "G"), ("G", "F"), ("F", "$"), ("G", "$")} <= inner


def test_wildcards_cycles_and_missing_names(spark):
    text = f"""<x:schema {X}><x:element name="R" type="R"/><x:complexType name="R"><x:sequence><x:element name="R" type="R" minOccurs="0"/><x:any minOccurs="0"/></x:sequence></x:complexType>
<x:complexType name="L"><x:complexContent><x:extension base="M"><x:sequence><x:element name="a" type="Nowhere"/></x:sequence></x:extension></x:complexContent></x:complexType>
<x:complexType name="M"><x:complexContent><x:extension base="L"><x:sequence><x:element ref="gone"/></x:sequence></x:extension></x:complexContent></x:complexType></x:schema>"""
    sets = sets_of(spark, {"c.xsd": text})
    names = {(r.owner[-1], r.name) for r in sets.declarations.where("owner like '%L' or owner like '%M'").collect()}
    assert names == {("L", "a"), ("L", "gone"), ("M", "a"), ("M", "gone")}
    deep = 40
    docs = spark.createDataFrame([("d", ("<R>" * deep + "<Any/>" + "</R>" * deep).encode())], "doc_id string, content binary")
    rows = shred.shredded(docs).persist()
    typed = conform.typed_elements(shred.elements(rows).withColumn("set_id", F.lit("c.xsd")), sets.declarations).persist()
    assert typed.where("declared").count() == deep and conform.check_against(typed, shred.attributes(rows), sets).count() == 0
    assert sets_of(spark, {"e.xsd": "<none/>"}).declarations.count() == 0


GROUPS = f"""<x:schema {X} targetNamespace="urn:g" xmlns="urn:g"><x:element name="H" type="x:int"/><x:element name="I" substitutionGroup="H"/><x:element name="J" substitutionGroup="I" abstract="true"/><x:element name="K" substitutionGroup="J" type="Short"/>
<x:element name="L" substitutionGroup="gone"/><x:element name="Y" substitutionGroup="Z"/><x:element name="Z" substitutionGroup="Y"/>
<x:group name="G"><x:sequence><x:element ref="H" maxOccurs="unbounded"/></x:sequence></x:group>
<x:element name="R"><x:complexType><x:sequence><x:element ref="I"/><x:element name="S" type="Narrow"/><x:group ref="G"/><x:element ref="Y" minOccurs="0"/></x:sequence></x:complexType></x:element>
<x:simpleType name="Short"><x:restriction base="x:int"><x:maxInclusive value="9"/></x:restriction></x:simpleType>
<x:simpleType name="Wide"><x:union memberTypes="x:date Short"><x:simpleType><x:union memberTypes="Word"/></x:simpleType></x:union></x:simpleType>
<x:simpleType name="Word"><x:restriction base="x:string"><x:enumeration value="none"/><x:enumeration value="all"/></x:restriction></x:simpleType>
<x:simpleType name="Narrow"><x:restriction base="Wide"/></x:simpleType></x:schema>"""


@pytest.fixture(scope="module")
def groups(spark):
    return sets_of(spark, {"g.xsd": GROUPS})


def test_what_may_stand_for_an_element_is_a_choice(groups):
    rows = groups.declarations.where("owner like '%#%' and owner <> '#root'").collect()
    short = lambda t: t.split("}")[-1]
    got = sorted((r.pos, r.name, short(r.type_ref), r.min_occurs, r.max_occurs, r.choice_id is not None) for r in rows)
    # J is abstract; I lends it, and has from H, the type int; K has its own; Y and Z stand for each other
    assert got == [(1, "I", "int", 1, 1, True), (1, "K", "Short", 1, 1, True), (2, "S", "Narrow", 1, 1, False), (3, "H", "int", 0, None, False), (3, "I", "int", 0, None, False), (3, "K", "Short", 0, None, False), (4, "Y", "anyType", 0, 1, True), (4, "Z", "anyType", 0, 1, True)]
    assert {r.name for r in groups.declarations.where("owner = '#root'").collect()} == {"H", "I", "K", "L", "R", "Y", "Z"}


def test_substitutes_and_unions_of_restricted_members_are_checked(spark, groups):
    cases = [
        ("I", "5", "<H>1</H><K>2</K><I>3</I><Z/>", set()), ("K", "2024-02-01", "<H>1</H>", set()), ("K", "all", "<K>10</K>", {("facet", "10")}), ("J", "none", "<H>1</H>", {("unknown-element", "J"), ("choice", "0"), ("content-model", "S after the start")}),
        ("I", "10", "<H>x</H>", {("union", "10"), ("datatype", "x")}), ("I", "some", "<H>1</H><Y/><Z/>", {("union", "some"), ("choice", "2"), ("content-model", "Z after Y")}), ("I", "", "", {("union", ""), ("content-model", "the end after S")}),
        ("I", "1", "<H>1</H><S>2</S>", {("too-many-elements", "2"), ("content-model", "S after H"), ("content-model", "the end after S")}),
    ]
    docs = [(str(i), f"<R><{first}>1</{first}><S>{value}</S>{rest}</R>".encode()) for i, (first, value, rest, _) in enumerate(cases)]
    rows = shred.shredded(spark.createDataFrame(docs, "doc_id string, content binary")).persist()
    typed = conform.typed_elements(shred.elements(rows).withColumn("set_id", F.lit("g.xsd")), groups.declarations).persist()
    found = {(r.doc_id, r.error_code, r.observed_value) for r in conform.check_against(typed, shred.attributes(rows), groups).collect()}
    assert found == {(str(i), *f) for i, (*_, want) in enumerate(cases) for f in want}


@pytest.mark.parametrize("file, location, want", [("a/b.xsd", "c.xsd", "a/c.xsd"), ("a/b.xsd", "../c.xsd", "c.xsd"), ("b.xsd", "./x/../c.xsd", "c.xsd"), ("b.xsd", "../c.xsd", "../c.xsd"), ("a/b.xsd", "http://h/c.xsd", "http://h/c.xsd"), ("a/b.xsd", "/c.xsd", "/c.xsd")])
def test_locations(spark, file, location, want):
    assert spark.range(1).select(resolve.joined_location(F.lit(file), F.lit(location))).first()[0] == want


@pytest.mark.parametrize("kind, good, bad", [("int", ["-5", "2147483647"], ["2147483648", "1.0", "", "9" * 50]), ("gYearMonth", ["2024-02", "2024-02Z"], ["2024", "2024-13"]), ("positiveInteger", ["1", "+007"], ["0", "-1"]), ("double", ["1e5", "INF", ".5"], ["e5", ""]), ("byte", ["-128"], ["128"]), ("hexBinary", ["", "0aFF"], ["0"])])
def test_built_in_types(spark, kind, good, bad):
    rows = [(kind, v, True) for v in good] + [(kind, v, False) for v in bad]
    got = spark.createDataFrame(rows, "k string, v string, want boolean").withColumn("got", conform.is_lexical(F.col("k"), F.col("v")))
    assert got.where("got is null or got <> want").count() == 0


def test_fixpoint_ends_on_cycles_and_puts_tables_together(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 7) for i in range(7)], "a int, b int")
    start = spark.createDataFrame([(0,)], "x int")
    got = grown(start, lambda f: f.join(edges, F.col("x") == F.col("a")).select(F.col("b").alias("x")), ["x"], together=2)
    assert sorted(r.x for r in got.collect()) == list(range(7))
    with pytest.raises(RuntimeError):
        grown(start, lambda f: f.select((F.col("x") + 1).alias("x")), ["x"], most=3)


def graph(spark, rows):
    return spark.createDataFrame([("g", s, p, o, k, None, None) for s, p, o, k in rows], "graph_id string, s string, p string, o string, o_kind string, o_datatype string, o_lang string")


def test_node_shapes_reach_untyped_nodes_and_end_on_rings(spark):
    typ = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    t = graph(spark, [("a", typ, TERMS + "T", "iri"), ("a", "p", "b", "iri"), ("b", "p", "a", "iri"), ("b", "v", "123.450", "literal"), ("a", "v", "1", "literal"), ("a", "p", "text", "literal")])
    rows = [("S", "p", "node", "U", "violation", None, None), ("U", "p", "node", "S", "violation", None, None), ("U", "v", "fractionDigits", "1", "violation", None, None), ("U", "v", "totalDigits", "5", "violation", None, None), ("S", "w", "minCount", "1", "warning", None, None)]
    table = spark.createDataFrame([(s, TERMS + ("T" if s == "S" else "None"), p, k, v, sev, g, b) for s, p, k, v, sev, g, b in rows], "shape string, target_class string, path string, kind string, value string, severity string, group_id string, branch string")
    got = {(r.focus, r.shape, r.component, r.value) for r in shapes.validate_shapes(t, table, t.where("false")).collect()}
    # b fails U by its two decimal places, so a fails S; the warning of a fails nothing; a literal conforms to U: it has no properties
    assert got == {("a", "S", "node", "b"), ("a", "S", "minCount", None)}


def test_triples_are_written_in_few_files_and_hot_predicates_in_many(spark, tmp_path):
    rows = spark.range(6000).select(F.concat(F.lit("g"), F.col("id") % 50).alias("graph_id"), F.concat(F.lit("s"), "id").alias("s"), F.when(F.col("id") % 6 == 0, F.concat(F.lit("p"), F.col("id") % 5)).otherwise("type").alias("p"), F.lit("o").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    documents.write_triples(rows.repartition(16), str(tmp_path / "t"), "parquet", file_rows=500)
    files = {}
    for f in (tmp_path / "t").glob("p=*/*.parquet"):
        files[f.parent.name] = files.get(f.parent.name, 0) + 1
    assert files.pop("p=type") >= 6 and len(files) == 5 and max(files.values()) <= 3
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "t")).select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
