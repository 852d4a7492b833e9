"""Instances as triples, and links between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import local_name_from_arcrole, mint_path_iri
from ..schemas import BASE, RDF, TERMS, XSD
from .conform import finding

XLINK = "http://www.w3.org/1999/xlink"


def node_iri(doc_id: Column, path: Column, xml_id: Column | None = None, base: str = BASE) -> Column:
    """PRJ2: a stable IRI: the XML id where there is one, else a hash of the path."""
    key = F.substring(F.sha2(path, 256), 1, 20)
    return mint_path_iri(F.lit("instance"), doc_id, F.coalesce(F.nullif(xml_id, F.lit("")), key) if xml_id is not None else key, base=base)


def project_instances(typed: DataFrame, attributes: DataFrame | None = None, terms: str = TERMS, base: str = BASE, datatypes: dict[str, str] | None = None, once: bool = False) -> DataFrame:
    """PRJ1: triples of declared elements with their place (as far as ``typed`` has it): containers become typed resources, values and
    attributes literals with a datatype, containment an object fact. Repeats are repeated facts; equal triples are one.

    Where ``typed`` has ``attrs, own_id, up_id, parent_path, again``, a row tells all its facts by itself, so nothing is joined. With ``once``
    no documents share a ``doc_id`` and none is ``alike``: then what the parser found to be said ``again`` are all repeats, and nothing is
    shuffled to be distinct.
    """
    els = typed.where("declared")
    if attributes is None:
        named = F.coalesce("attrs", F.array().cast("array<struct<ns:string,name:string,value:string>>"))
        plain = F.filter(named, lambda a: a["name"] != "id")
        els = els.withColumn("xml_id", F.col("own_id")).withColumn("n_attrs", F.when(F.size("attrs") > 0, F.size(plain)).otherwise(0))
        els = els.withColumn("attrs", F.when(F.size("attrs") > 0, F.filter(plain, lambda a: F.coalesce(a["ns"], F.lit("")) != XLINK)))
        els = els.withColumn("iri", node_iri(F.col("doc_id"), F.col("path"), F.col("xml_id"), base)).withColumn("up_iri", F.when(F.col("up_declared"), node_iri(F.col("doc_id"), F.col("parent_path"), F.col("up_id"), base)))
    else:
        own = attributes.groupBy("doc_id", "seq").agg(
            F.min(F.when(F.col("name") == "id", F.col("value"))).alias("xml_id"), F.count_if(F.col("name") != "id").alias("n_attrs"),
            F.collect_list(F.when((F.col("name") != "id") & (F.coalesce("ns", F.lit("")) != XLINK), F.struct("ns", "name", "value"))).alias("attrs"),
        )
        els = els.join(own, ["doc_id", "seq"], "left").withColumn("iri", node_iri(F.col("doc_id"), F.col("path"), F.col("xml_id"), base))
        up = els.select("doc_id", F.col("seq").alias("parent_seq"), F.col("iri").alias("up_iri"))
        els = els.join(up, ["doc_id", "parent_seq"], "left")
    els = els.withColumn("is_node", (F.col("n_children") > 0) | (F.coalesce("n_attrs", F.lit(0)) > 0) | (F.col("depth") == 0) | F.col("xml_id").isNotNull())
    known = F.create_map(*[x for k, v in (datatypes or {"Amount": "decimal", "Count": "int", "Year": "int", "Indicator": "boolean"}).items() for x in (F.lit(k), F.lit(XSD + v))])
    dt = F.coalesce(F.try_element_at(known, "type_ref"), F.lit(XSD + "string"))
    none = F.lit(None).cast("string")
    term = lambda c: F.concat(F.lit(terms), c)

    def fact(s, p, o, kind, datatype=none):
        return F.struct(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), datatype.alias("o_datatype"))

    # all facts of an element leave in one pass
    iri, text, node = F.col("iri"), F.col("text"), F.col("is_node")
    below = (F.col("depth") > 0) & F.col("up_iri").isNotNull()
    facts = F.array(
        F.when(node, fact(iri, F.lit(RDF + "type"), term(F.col("type_ref")), "iri")),
        F.when(below & node, fact(F.col("up_iri"), term(F.col("local_name")), iri, "iri")),
        F.when(below & ~node, fact(F.col("up_iri"), term(F.col("local_name")), F.coalesce(text, F.lit("")), "literal", dt)),
        F.when(node & (F.col("n_children") == 0) & (text != "") & (F.col("depth") > 0), fact(iri, F.lit(RDF + "value"), text, "literal", dt)),
    )
    held = F.transform(F.coalesce("attrs", F.array().cast("array<struct<ns:string,name:string,value:string>>")), lambda a: fact(iri, term(a["name"]), a["value"], "literal", F.lit(XSD + "string")))
    place = [c for c in ("path", "line", "col") if c in els.columns]
    if once:
        els = els.where("not again")
    rows = els.select(F.col("doc_id").alias("graph_id"), *place, F.explode(F.concat(facts, held)).alias("f")).where("f is not null")
    out = rows.select("graph_id", "f.*", none.alias("o_lang"), *place)
    return out if once else out.dropDuplicates(["graph_id", "s", "p", "o", "o_kind", "o_datatype"])


def unprojectable(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ3: (findings of constructs that no declaration covers, documents without any): nothing is guessed."""
    bad = typed.where(F.col("declared").isNull())
    found = bad.select(*finding("unsupported-construct", F.concat(F.lit("Unsupported construct "), "local_name"), F.col("local_name"), F.col("path"), F.lit("a declared construct")))
    return found, typed.groupBy("doc_id").agg(F.bool_or(F.col("declared").isNull()).alias("bad")).where("not bad").select("doc_id")


_ARC = ("arcrole", "from", "to", "label", "type")


def link_attributes(attributes: DataFrame, ns: str | None = XLINK) -> DataFrame:
    """Link attributes side by side, from a fixed list."""
    own = attributes if ns is None else attributes.where(F.col("ns") == ns)
    return own.where(F.col("name").isin(*_ARC)).groupBy("doc_id", "seq").pivot("name", list(_ARC)).agg(F.first("value"))


def link_arcs(attributes: DataFrame, ns: str | None = XLINK) -> tuple[DataFrame, DataFrame]:
    """LNK1: (arcs ``doc_id, seq, arcrole, from, to``; labels ``doc_id, seq, label``)."""
    wide = link_attributes(attributes, ns)
    return wide.where("`from` is not null or `to` is not null or arcrole is not null").select("doc_id", "seq", "arcrole", "from", "to"), wide.where("label is not null").select("doc_id", "seq", "label")


def resolve_links(arcs: DataFrame, labels: DataFrame, nodes: DataFrame, predicates_ns: str = BASE + "predicate#") -> DataFrame:
    """LNK2: triples of the arcs whose ends both resolve inside their document (``nodes``: doc_id, seq, iri)."""
    ends = labels.join(nodes, ["doc_id", "seq"]).select("doc_id", "label", "iri")
    out = arcs.join(ends.select("doc_id", F.col("label").alias("from"), F.col("iri").alias("s")), ["doc_id", "from"])
    out = out.join(ends.select("doc_id", F.col("label").alias("to"), F.col("iri").alias("o")), ["doc_id", "to"])
    name = local_name_from_arcrole(F.col("arcrole"))
    none = F.lit(None).cast("string")
    return out.where(name.isNotNull()).select(F.col("doc_id").alias("graph_id"), "s", F.concat(F.lit(predicates_ns), name).alias("p"), "o", F.lit("iri").alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang")).dropDuplicates()


def link_findings(arcs: DataFrame, labels: DataFrame, arcroles: DataFrame) -> DataFrame:
    """LNK3: ``doc_id, seq, error_code, observed_value``: missing ends, unknown arcroles, labels used twice (once each)."""
    have = labels.select("doc_id", "label").distinct()
    ends = arcs.select("doc_id", "seq", F.explode(F.array("from", "to")).alias("label"))
    missing = ends.join(have, ["doc_id", "label"], "left_anti").select("doc_id", "seq", F.lit("missing-endpoint").alias("error_code"), F.col("label").alias("observed_value"))
    unknown = arcs.join(arcroles.select(F.col("source_uri").alias("arcrole")).distinct(), "arcrole", "left_anti").select("doc_id", "seq", F.lit("unknown-arcrole").alias("error_code"), F.col("arcrole").alias("observed_value"))
    twice = labels.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq")).where("n > 1").select("doc_id", "seq", F.lit("duplicate-label").alias("error_code"), F.col("label").alias("observed_value"))
    return missing.unionByName(unknown).unionByName(twice)


def arcrole_parts(c: Column) -> Column:
    """``SUBJECT_Predicate_OBJECT`` of an arcrole's name: upper-case ends, mixed-case middle."""
    name = local_name_from_arcrole(c)
    part = lambda i: F.nullif(F.regexp_extract(name, r"\A([A-Z0-9]+(?:_[A-Z0-9]+)*)_([A-Z][a-z]\w*?)_([A-Z0-9]+(?:_[A-Z0-9]+)*)\z", i), F.lit(""))
    return F.struct(part(1).alias("subject_kind"), part(2).alias("predicate"), part(3).alias("object_kind"))


def disallowed_links(arcs: DataFrame, labels: DataFrame, elements: DataFrame) -> DataFrame:
    """LNK4: arcs whose ends are not of the kinds that the arcrole's name says; unresolved ends are LNK3's."""
    ends = labels.join(elements.select("doc_id", "seq", "local_name"), ["doc_id", "seq"]).select("doc_id", "label", "local_name")
    out = arcs.withColumn("want", arcrole_parts(F.col("arcrole"))).where("want.predicate is not null")
    out = out.join(ends.select("doc_id", F.col("label").alias("from"), F.col("local_name").alias("from_kind")), ["doc_id", "from"]).join(ends.select("doc_id", F.col("label").alias("to"), F.col("local_name").alias("to_kind")), ["doc_id", "to"])
    bad = out.where("from_kind <> want.subject_kind or to_kind <> want.object_kind")
    return bad.select("doc_id", "seq", "arcrole", "from_kind", "to_kind", F.col("want.subject_kind").alias("wanted_from"), F.col("want.object_kind").alias("wanted_to"))
