"""Vocabularies: schema rows to triples. Each generator dedupes once, at its end (a graph is a set)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import documentation_text, label_from_local_name, local_name, local_name_from_arcrole, local_name_from_text, strip_prefix, strip_type_suffix, with_fragment_separator
from ..schemas import BASE, OWL, RDF, RDFS, SKOS, TERMS, XSD, XSD_NS

VALUES, CLASSES, PREDICATES = BASE + "value#", BASE + "schema#", BASE + "predicate#"
TYPE, LABEL, COMMENT, SUBCLASS, RANGE = RDF + "type", RDFS + "label", RDFS + "comment", RDFS + "subClassOf", RDFS + "range"


def po(p: str, o: Column, kind: str = "literal", datatype: str | None = None) -> Column:
    """A predicate-object pair; pairs whose object is null are left out of the graph."""
    return F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"))


def iri(text: str) -> Column:
    return F.lit(text)


def explode_triples(df: DataFrame, graph: Column, subject: Column, pairs: list[Column]) -> DataFrame:
    rows = df.select(graph.alias("graph_id"), subject.alias("s"), F.explode(F.array(*pairs)).alias("x")).where("x.o is not null and s is not null")
    return rows.select("graph_id", "s", "x.p", "x.o", "x.o_kind", "x.o_datatype", F.lit(None).cast("string").alias("o_lang"))


def _docs(elements: DataFrame) -> DataFrame:
    """Direct documentation of each element path."""
    d = elements.where((F.col("ns") == XSD_NS) & (F.col("local_name") == "documentation") & F.col("parent_path").rlike(r"/annotation\[\d+\]\z"))
    d = d.select("doc_id", F.regexp_replace("parent_path", r"/annotation\[\d+\]\z", "").alias("path"), "seq", F.coalesce("text", F.lit("")).alias("text"))
    return d.groupBy("doc_id", "path").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("t")).select("doc_id", "path", documentation_text(F.col("t.text")).alias("doc"))


def _attribute(attributes: DataFrame, name: str, alias: str) -> DataFrame:
    return attributes.where(F.col("ns").isNull() & (F.col("name") == name)).select("doc_id", "seq", F.col("value").alias(alias))


def _paths_up(c: Column) -> Column:
    """All proper ancestors' paths of an indexed path."""
    steps = F.split(c, "/", -1)
    return F.when(F.size(steps) > 2, F.transform(F.sequence(F.lit(2), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def enumerations(elements: DataFrame, attributes: DataFrame) -> DataFrame:
    """VOC1: values of named simple types at any depth: ``doc_id, type_name, scheme_local_name, type_doc, seq, value, value_local_name, doc``."""
    x = elements.where(F.col("ns") == XSD_NS)
    types = x.where("local_name = 'simpleType'").join(_attribute(attributes, "name", "type_name"), ["doc_id", "seq"]).where("type_name <> ''")
    types = types.join(_docs(elements).withColumnRenamed("doc", "type_doc"), ["doc_id", "path"], "left").select("doc_id", F.col("path").alias("up"), "type_name", "type_doc")
    values = x.where("local_name = 'enumeration'").join(_attribute(attributes, "value", "value"), ["doc_id", "seq"]).where("value <> ''")
    values = values.join(_docs(elements), ["doc_id", "path"], "left").select("doc_id", "seq", "value", "doc", F.explode(_paths_up(F.col("path"))).alias("up"))
    out = types.join(values, ["doc_id", "up"])
    return out.select("doc_id", "type_name", local_name_from_text(strip_type_suffix(F.col("type_name"))).alias("scheme_local_name"), "type_doc", "seq", "value", local_name_from_text(F.col("value")).alias("value_local_name"), "doc")


def enumeration_triples(rows: DataFrame, graph: str = "graph_id", values_ns: str = VALUES, terms: str = TERMS) -> DataFrame:
    """VOC2: a concept scheme per type and a concept per value. Names that collide after minting share one IRI."""
    scheme = F.concat(F.lit(values_ns), "scheme_local_name")
    schemes = rows.select(graph, "type_name", "scheme_local_name", "type_doc").distinct()
    a = explode_triples(schemes, F.col(graph), scheme, [
        po(TYPE, iri(SKOS + "ConceptScheme"), "iri"), po(LABEL, F.col("scheme_local_name")), po(SKOS + "prefLabel", F.col("scheme_local_name")),
        po(terms + "sourceSimpleTypeName", F.col("type_name")), po(COMMENT, F.col("type_doc")),
    ])
    concept = F.concat(scheme, F.lit("-"), "value_local_name")
    b = explode_triples(rows, F.col(graph), concept, [
        po(TYPE, iri(SKOS + "Concept"), "iri"), po(SKOS + "inScheme", scheme, "iri"), po(SKOS + "prefLabel", F.col("value")),
        po(terms + "sourceEnumerationValue", F.col("value")), po(COMMENT, F.col("doc")),
    ])
    return a.unionByName(b).dropDuplicates()


def complex_types(elements: DataFrame, attributes: DataFrame) -> DataFrame:
    """VOC3: named complex types at any depth; the base is that of the first extension below, else of the first restriction."""
    x = elements.where(F.col("ns") == XSD_NS)
    types = x.where("local_name = 'complexType'").join(_attribute(attributes, "name", "type_name"), ["doc_id", "seq"]).where("type_name <> ''").select("doc_id", "seq", "path", "type_name")
    based = x.where("local_name in ('extension', 'restriction')").join(_attribute(attributes, "base", "base"), ["doc_id", "seq"], "left")
    based = based.select("doc_id", F.explode(_paths_up(F.col("path"))).alias("path"), "base", F.when(F.col("local_name") == "extension", 0).otherwise(1).alias("rank"), F.col("seq").alias("b_seq"))
    best = based.join(types.select("doc_id", "path"), ["doc_id", "path"], "left_semi").groupBy("doc_id", "path").agg(F.min(F.struct("rank", "b_seq", "base")).alias("b"))
    out = types.join(best, ["doc_id", "path"], "left").join(_docs(elements), ["doc_id", "path"], "left")
    return out.select("doc_id", "type_name", local_name_from_text(strip_type_suffix(F.col("type_name"))).alias("class_local_name"), "doc", strip_prefix(F.col("b.base")).alias("base_type_name"))


def complex_type_triples(types: DataFrame, graph: str = "graph_id", subclass: bool = True, classes_ns: str = CLASSES, terms: str = TERMS) -> DataFrame:
    """VOC4: a class per complex type; ``subclass`` decides whether the base also becomes a subclass axiom."""
    base = F.concat(F.lit(classes_ns), local_name_from_text(strip_type_suffix(F.col("base_type_name"))))
    pairs = [
        po(TYPE, iri(OWL + "Class"), "iri"), po(TYPE, iri(terms + "SchemaComponent"), "iri"), po(LABEL, F.col("class_local_name")),
        po(terms + "sourceComplexTypeName", F.col("type_name")), po(COMMENT, F.col("doc")), po(terms + "sourceBaseTypeName", F.col("base_type_name")),
    ]
    if subclass:
        pairs.append(po(SUBCLASS, base, "iri"))
    return explode_triples(types, F.col(graph), F.concat(F.lit(classes_ns), "class_local_name"), pairs).dropDuplicates()


def arcroles(elements: DataFrame, attributes: DataFrame, type_name: str = "ArcroleBase") -> DataFrame:
    """VOC5: the enumeration values of each file's first simple type of that name; a file without it has no rows."""
    x = elements.where((F.col("ns") == XSD_NS) & (F.col("local_name") == "simpleType")).join(_attribute(attributes, "name", "name"), ["doc_id", "seq"]).where(F.col("name") == type_name)
    first = x.groupBy("doc_id").agg(F.min_by("path", "seq").alias("up"))
    values = elements.where((F.col("ns") == XSD_NS) & (F.col("local_name") == "enumeration")).join(_attribute(attributes, "value", "value"), ["doc_id", "seq"]).where("value <> ''")
    values = values.join(first, "doc_id").where(F.col("path").startswith(F.concat("up", F.lit("/"))))
    return values.join(_docs(elements), ["doc_id", "path"], "left").select("doc_id", F.col("value").alias("source_uri"), local_name_from_arcrole(F.col("value")).alias("local_name"), "doc")


def arcrole_triples(rows: DataFrame, graph: str = "graph_id", predicates_ns: str = PREDICATES, terms: str = TERMS) -> DataFrame:
    """VOC6: an object property per arcrole."""
    return explode_triples(rows, F.col(graph), F.concat(F.lit(predicates_ns), "local_name"), [
        po(TYPE, iri(OWL + "ObjectProperty"), "iri"), po(TYPE, iri(terms + "RelationshipPredicate"), "iri"), po(LABEL, label_from_local_name(F.col("local_name"))),
        po(terms + "sourceArcroleUri", F.col("source_uri"), "literal", XSD + "anyURI"), po(COMMENT, F.col("doc")),
    ]).dropDuplicates()


def schema_triples(elements: DataFrame, attributes: DataFrame, default_namespace: str = BASE + "examples#") -> DataFrame:
    """VOC7: global complex types become classes, global elements object properties with their type as range; names live
    in the file's target namespace, or the default one."""
    x = elements.where(F.col("ns") == XSD_NS)
    space = x.where("depth = 0").join(_attribute(attributes, "targetNamespace", "tns"), ["doc_id", "seq"], "left")
    space = space.select("doc_id", with_fragment_separator(F.coalesce(F.nullif("tns", F.lit("")), F.lit(default_namespace))).alias("space"))
    top = x.where("depth = 1").join(_attribute(attributes, "name", "name"), ["doc_id", "seq"]).where("name <> ''").join(_attribute(attributes, "type", "type"), ["doc_id", "seq"], "left").join(space, "doc_id")
    subject = F.concat("space", "name")
    a = explode_triples(top.where("local_name = 'complexType'"), F.col("doc_id"), subject, [po(TYPE, iri(OWL + "Class"), "iri")])
    to = F.when(F.col("type") != "", F.concat("space", F.substring_index("type", ":", -1)))
    b = explode_triples(top.where("local_name = 'element'"), F.col("doc_id"), subject, [po(TYPE, iri(OWL + "ObjectProperty"), "iri"), po(RANGE, to, "iri")])
    return a.unionByName(b).dropDuplicates()


def refine_properties(components: DataFrame, builtin_prefixes: tuple[str, ...] = ("xsd", "xs")) -> DataFrame:
    """VOC8: ``file, name, kind, range``: elements of a complex type are object properties; those of a simple or built-in
    type, and attributes, are datatype properties."""
    complex_ = components.where("construct = 'complexType'").select("file", F.col("name").alias("type_local")).distinct().withColumn("is_complex", F.lit(True))
    rows = components.where("construct in ('element', 'attribute') and name is not null").withColumn("type_local", local_name(F.col("type_ref")))
    rows = rows.join(complex_, ["file", "type_local"], "left")
    prefix = F.when(F.col("type_ref").contains(":"), F.substring_index("type_ref", ":", 1))
    builtin = prefix.isin(*builtin_prefixes)
    kind = F.when((F.col("construct") == "element") & F.col("is_complex") & ~F.coalesce(builtin, F.lit(False)), "ObjectProperty").otherwise("DatatypeProperty")
    to = F.when(builtin, F.concat(F.lit(XSD), "type_local")).otherwise(F.col("type_local"))
    return rows.select("file", "name", kind.alias("kind"), to.alias("range")).distinct()


def structural_shapes(components: DataFrame, terms: str = TERMS) -> DataFrame:
    """VOC9: shape rows from components: datatype, occurrence and facets of what each owner declares."""
    target = F.concat(F.lit(terms), "owner")
    used = components.where("construct = 'element' and owner is not null and name is not null")
    base = [F.concat(F.lit("shape:"), "owner").alias("shape"), target.alias("target_class"), F.concat(F.lit(terms), "name").alias("path")]
    part = lambda kind, value, rows: rows.select(*base, F.lit(kind).alias("kind"), value.cast("string").alias("value")).where("value is not null")
    out = part("minCount", F.when(F.col("min_occurs") > 0, F.col("min_occurs")), used).unionByName(part("maxCount", F.col("max_occurs"), used))
    simple = components.where("construct = 'simpleType'").select("file", F.col("name").alias("type_local")).distinct()
    local = local_name(F.col("type_ref"))
    out = out.unionByName(part("datatype", F.when(F.col("type_ref").rlike(r"\Axsd?:"), F.concat(F.lit(XSD), local)), used))
    names = {"maxLength": "maxLength", "minLength": "minLength", "minInclusive": "minInclusive", "maxInclusive": "maxInclusive", "pattern": "pattern", "enumeration": "in"}
    facets = components.where(F.col("construct").isin(*names)).select("file", F.col("owner").alias("type_local"), F.col("construct").alias("facet"), F.col("name").alias("limit"))
    on_type = used.withColumn("type_local", local).join(simple, ["file", "type_local"], "left_semi").join(facets, ["file", "type_local"])
    kind = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])[F.col("facet")]
    value = F.when(F.col("facet") == "pattern", F.concat(F.lit(r"\A(?:"), "limit", F.lit(r")\z"))).otherwise(F.col("limit"))
    return out.unionByName(on_type.select(*base, kind.alias("kind"), value.alias("value"))).distinct()


def set_properties(sets) -> DataFrame:
    """VOC8 over includes and imports: ``set_id, name, kind, range`` of all elements and attributes of ``sets`` (``resolve.SchemaSets``).
    Elements whose type has element content are object properties; those with a value (also one with attributes) and attributes
    are datatype properties."""
    objects = sets.types.where("kind = 'complex'").join(sets.unions.select("type_ref").distinct(), "type_ref", "left_anti").select("type_ref", F.lit(True).alias("is_object"))
    rows = sets.declarations.where("name <> '*'").select("set_id", "name", "type_ref").unionByName(sets.attributes.select("set_id", "name", "type_ref"))
    rows = rows.distinct().join(objects, "type_ref", "left")
    return rows.select("set_id", "name", F.when(F.col("is_object"), "ObjectProperty").otherwise("DatatypeProperty").alias("kind"), _range(F.col("type_ref")).alias("range")).distinct()


def _range(type_ref: Column) -> Column:
    """A built-in type's IRI, else the local name; null for a type without a name."""
    name = F.regexp_replace(type_ref, r"\A.*\}", "")
    return F.when(~type_ref.contains("|"), F.concat(F.lit(XSD), type_ref)).when(~name.startswith("#"), name)


def set_shapes(sets, terms: str = TERMS) -> DataFrame:
    """VOC9 over includes, imports and inheritance: ``set_id, shape, target_class, path, kind, value, severity, group_id, branch``.

    What a type inherits is part of its shape. Elements of a type with element content get ``node`` and its shape; required ones
    get counts, the branches of a required choice alternatives (``group_id, branch``); values get datatype, facets and lists,
    those of a union an alternative per member; attributes are properties like elements. Facets of digits are kept.
    """
    bare = lambda c: F.regexp_replace(c, r"\A.*\}", "")
    kinds = ("minLength", "maxLength", "minInclusive", "maxInclusive", "fractionDigits", "totalDigits", "pattern")
    simple = sets.unions.select("type_ref").distinct().withColumn("has_value", F.lit(True))
    elements = sets.declarations.where("owner <> '#root' and name <> '*'").select("set_id", "owner", "name", "type_ref", "min_occurs", "max_occurs", "fixed", "choice_id", "branch")
    one, none = F.lit(1), F.lit(None).cast("string")
    attributes = sets.attributes.select("set_id", "owner", "name", "type_ref", F.when(F.col("use") == "required", 1).otherwise(0).alias("min_occurs"), one.alias("max_occurs"), "fixed", none.alias("choice_id"), none.alias("branch"))
    complex_ = sets.types.where("kind = 'complex'").select("type_ref", F.lit(True).alias("is_complex"))
    used = elements.unionByName(attributes).join(simple, "type_ref", "left").join(complex_, "type_ref", "left")
    base = ["set_id", F.concat(F.lit("shape:"), bare(F.col("owner"))).alias("shape"), F.concat(F.lit(terms), bare(F.col("owner"))).alias("target_class"), F.concat(F.lit(terms), "name").alias("path")]

    def part(rows: DataFrame, kind: Column, value: Column, group: Column = none, branch: Column = none) -> DataFrame:
        return rows.select(*base, kind.alias("kind"), value.cast("string").alias("value"), F.lit("violation").alias("severity"), group.alias("group_id"), branch.alias("branch")).where("value is not null")

    single = sets.unions.groupBy("type_ref").agg(F.count("*").alias("n"), F.min("member").alias("member"))
    valued = used.where("has_value or type_ref not like '%|%'").join(single, "type_ref", "left")
    builtin = F.when(~F.col("type_ref").contains("|"), F.col("type_ref")).when(F.col("n") == 1, F.col("member"))
    limits = sets.facets.where(F.col("facet").isin(*kinds)).join(used.where("has_value"), "type_ref")
    alternatives = sets.unions.join(single.where("n > 1").select("type_ref"), "type_ref").join(used.where("has_value"), "type_ref")
    pattern = F.when(F.col("facet") == "pattern", F.concat(F.lit(r"\A(?:"), "limit", F.lit(r")\z"))).otherwise(F.col("limit"))
    least = F.when(F.col("min_occurs") > 0, F.col("min_occurs"))
    parts = [
        part(used.where("choice_id is null"), F.lit("minCount"), least), part(used.where("choice_id is not null"), F.lit("minCount"), least, bare(F.col("choice_id")), F.col("branch")),
        part(used, F.lit("maxCount"), F.col("max_occurs")), part(valued, F.lit("datatype"), F.when(~builtin.isin("anyType", "anySimpleType"), F.concat(F.lit(XSD), builtin))),
        part(alternatives, F.lit("datatype"), F.concat(F.lit(XSD), "member"), F.concat("name", F.lit(" type")), F.col("member")),
        part(limits, F.col("facet"), pattern), part(sets.values.join(used.where("has_value"), "type_ref"), F.lit("in"), F.col("value")), part(used, F.lit("in"), F.col("fixed")),
        part(used.where("is_complex and has_value is null"), F.lit("node"), F.concat(F.lit("shape:"), bare(F.col("type_ref")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
