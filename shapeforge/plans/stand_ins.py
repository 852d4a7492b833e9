"""Domain tables derived from the driver's tables by Spark: star graphs, order documents, schema documents, runs.

An order is a report: its customer the property it appraises, its line items the valuation approaches. Residues of the
order key plant defects, so the expected rows follow from the base tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fixpoint import shared_folder
from ..schemas import OWL, RDF, RDFS, TERMS, XSD

T = TERMS
TYPE, SUBCLASS = RDF + "type", RDFS + "subClassOf"
APPROACH = {"R": "SalesComparisonApproach", "A": "CostApproach", "N": "IncomeApproach"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _facts(items: list[tuple]) -> Column:
    """A list of facts, null where their condition doesn't hold; items: (condition or None, s, p, o, kind, datatype)."""
    made = [
        F.when(F.lit(True) if c is None else c, F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(k).alias("o_kind"), F.lit(d).cast("string").alias("o_datatype")))
        for c, s, p, o, k, d in items
    ]
    return F.array(*made)


def _triples(rows: DataFrame, graph: Column, facts: Column) -> DataFrame:
    x = rows.select(graph.alias("graph_id"), F.explode(facts).alias("t")).where("t is not null")
    return x.select("graph_id", "t.*", F.lit(None).cast("string").alias("o_lang"))


#: Orders of a task that makes their documents or graphs and goes on with them, about.
TASK_ORDERS = 50_000


def _tasks(orders: DataFrame) -> int:
    """Short rows become much work, so they are dealt by the number of orders, not by bytes."""
    return max(orders.sparkSession.sparkContext.defaultParallelism, -(-orders.count() // TASK_ORDERS))


def star_graph(spark: SparkSession, sf_dir: str, by_graph: bool = False) -> DataFrame:
    """One graph per order. With ``by_graph`` the short rows that graphs are made of are dealt by graph, so that what works on a graph's
    triples needs no shuffle of triples; facts that repeat within a line then stay repeated."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    o = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "c_acctbal", "c_mktsegment")
    key = F.col("o_orderkey").cast("string")
    node = lambda prefix, c=key: F.concat(F.lit(prefix), c)
    order, cust = node("order-"), node("cust-", F.col("o_custkey").cast("string"))
    mod = lambda n: F.col("o_orderkey") % n == 0
    cls = lambda c: F.lit(T + c)
    good, fine = F.col("c_acctbal") > 0, F.col("c_mktsegment") != "BUILDING"
    of_order = _facts([
        (None, order, TYPE, cls("Appraisal"), "iri", None), (None, order, T + "appraisesProperty", cust, "iri", None),
        (~mod(13), cust, TYPE, cls("SubjectProperty"), "iri", None),
        (~mod(7), order, T + "hasOpinionOfValue", node("opinion-"), "iri", None), (~mod(7), node("opinion-"), TYPE, cls("OpinionOfValue"), "iri", None),
        (None, order, T + "hasReconciliation", node("rec1-"), "iri", None), (None, node("rec1-"), TYPE, cls("Reconciliation"), "iri", None),
        (mod(11), order, T + "hasReconciliation", node("rec2-"), "iri", None), (mod(11), node("rec2-"), TYPE, cls("Reconciliation"), "iri", None),
        (good, cust, T + "hasPropertyConditionRating", node("cond-"), "iri", None), (good, node("cond-"), TYPE, cls("PropertyConditionRating"), "iri", None),
        (fine, cust, T + "hasPropertyQualityRating", node("qual-"), "iri", None), (fine, node("qual-"), TYPE, cls("PropertyQualityRating"), "iri", None),
        (None, order, T + "status", F.col("o_orderstatus"), "literal", XSD + "string"), (None, order, T + "priority", F.col("o_orderpriority"), "literal", None),
        (None, order, T + "size", F.col("o_custkey") % 100, "literal", XSD + "int"),
    ])
    lkey = F.col("l_orderkey").cast("string")
    line = F.concat_ws("-", F.lit("line"), lkey, F.col("l_linenumber").cast("string"))
    flag, kinds = F.col("l_returnflag"), F.create_map(*[x for k, v in APPROACH.items() for x in (F.lit(k), F.lit(T + v))])
    if by_graph:
        of_line = _facts([
            (None, F.concat(F.lit("order-"), lkey), T + "usesValuationApproach", line, "iri", None), (None, line, TYPE, kinds[flag], "iri", None),
            (flag == "R", line, T + "usesComparableSale", F.concat(F.lit("part-"), F.col("l_partkey").cast("string")), "iri", None),
        ])
        rows = o.withColumn("graph_id", key).unionByName(lines.withColumn("graph_id", lkey), allowMissingColumns=True)
        return _triples(rows.repartition(_tasks(orders), "graph_id"), F.col("graph_id"), F.when(F.col("l_orderkey").isNull(), of_order).otherwise(of_line))
    a = _triples(o, key, of_order)
    # only the line items' facts can repeat (orders are unique), and they repeat within a line: its few keys are shuffled, never triples
    li = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.collect_set(F.struct(kinds[flag].alias("cls"))).alias("kinds"), F.collect_set(F.when(flag == "R", F.struct("l_partkey"))).alias("parts"),
    )
    none = F.lit(None).cast("string")
    fact = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_datatype"))
    facts = F.concat(
        F.array(fact(F.concat(F.lit("order-"), lkey), T + "usesValuationApproach", line)), F.transform("kinds", lambda k: fact(line, TYPE, k["cls"])),
        F.transform("parts", lambda x: fact(line, T + "usesComparableSale", F.concat(F.lit("part-"), x["l_partkey"].cast("string")))),
    )
    b = li.select(lkey.alias("graph_id"), F.explode(facts).alias("t")).select("graph_id", "t.*", none.alias("o_lang"))
    return a.unionByName(b)


def ontology(spark: SparkSession) -> DataFrame:
    """Class axioms that shape checks walk."""
    pairs = [("SubjectProperty", "RealProperty"), ("ComparableSale", "Evidence"), *((v, "ValuationApproach") for v in APPROACH.values())]
    rows = [("ontology", T + a, SUBCLASS, T + b, "iri") for a, b in pairs] + [("ontology", T + c, TYPE, OWL + "Class", "iri") for c in {x for p in pairs for x in p}]
    none = F.lit(None).cast("string")
    return spark.createDataFrame(rows, "graph_id string, s string, p string, o string, o_kind string").select("*", none.alias("o_datatype"), none.alias("o_lang"))


def shapes(spark: SparkSession) -> DataFrame:
    rows = []
    for shape, path, least, most, cls in (
        ("Appraisal", "appraisesProperty", 1, 1, "SubjectProperty"), ("Appraisal", "hasOpinionOfValue", 1, 1, "OpinionOfValue"),
        ("Appraisal", "usesValuationApproach", 1, None, "ValuationApproach"), ("Appraisal", "hasReconciliation", 1, 1, "Reconciliation"),
        ("SubjectProperty", "hasPropertyConditionRating", 1, 1, "PropertyConditionRating"), ("SubjectProperty", "hasPropertyQualityRating", 1, 1, "PropertyQualityRating"),
    ):
        for kind, value in (("minCount", least), ("maxCount", most), ("class", T + cls)):
            if value is not None:
                rows.append((f"{shape}Shape", T + shape, T + path, kind, str(value), "violation"))
    return spark.createDataFrame(rows, "shape string, target_class string, path string, kind string, value string, severity string")


def value_shapes(spark: SparkSession) -> DataFrame:
    rows = [("status", "in", "F"), ("status", "in", "O"), ("status", "datatype", XSD + "string"), ("priority", "pattern", "^[1-3]-"), ("priority", "maxLength", "10"), ("size", "maxInclusive", "89"), ("size", "minInclusive", "5"), ("size", "datatype", XSD + "int"), ("usesValuationApproach", "or", f"{T}SalesComparisonApproach|{T}CostApproach"), ("appraisesProperty", "node", "SubjectPropertyShape"), ("appraisesProperty", "nodeKind", "iri")]
    return spark.createDataFrame([("OrderShape", T + "Appraisal", T + p, k, v, "violation") for p, k, v in rows], "shape string, target_class string, path string, kind string, value string, severity string")


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, package_name, content``: an XML report per order, one element a line, with defects by residue.

    Documents are small and their parsing is not, so orders and line items are dealt as those of graphs.
    """
    orders = table(spark, sf_dir, "orders")
    n = _tasks(orders)
    orders = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority").repartition(n, "o_orderkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey").repartition(n, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_partkey"))).alias("ls"))
    o = orders.join(li, "o_orderkey", "left")
    mod = lambda n: F.col("o_orderkey") % n == 0
    el = lambda name, c: F.concat(F.lit(f"  <{name}>"), c, F.lit(f"</{name}>\n"))
    opt = lambda cond, c: F.when(cond, c).otherwise("")
    status = opt(~mod(17), el("Status", F.when(mod(23), F.concat(F.lit("\n    "), "o_orderstatus", F.lit("\n  "))).otherwise(F.col("o_orderstatus"))))
    date = el("Date", F.when(mod(29), F.lit("2024-13-45")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    date = F.concat(date, opt(mod(41), date))
    cash, loan = F.lit("  <Cash>1</Cash>\n"), F.lit("  <Loan>1</Loan>\n")
    choice = F.when(mod(59), "").when(mod(53), F.concat(cash, loan)).when(F.col("o_orderpriority") == "1-URGENT", cash).otherwise(loan)
    line = lambda x: F.concat(F.lit("  <Line"), F.when(mod(43), "").otherwise(F.concat(F.lit(' n="'), x["l_linenumber"].cast("string"), F.lit('"'))), F.lit("><Flag>"), x["l_returnflag"], F.lit("</Flag><Part>"), x["l_partkey"].cast("string"), F.lit("</Part></Line>\n"))
    lines = F.array_join(F.transform(F.coalesce("ls", F.array().cast("array<struct<l_linenumber:int,l_returnflag:string,l_partkey:bigint>>")), line), "")
    body = F.concat(
        el("Form", F.when(mod(61), F.lit("F2")).otherwise("F1")), F.when(mod(37), F.concat(date, status)).otherwise(F.concat(status, date)), choice,
        el("Size", (F.col("o_custkey") % 100).cast("string")), opt(mod(19), F.lit("  <Extra>1</Extra>\n")), lines,
    )
    head = F.concat(F.lit('<Report id="o'), F.col("o_orderkey").cast("string"), F.lit('"'), opt(mod(47), F.lit(' x="1"')), F.lit(">\n"))
    text = F.concat(head, body, opt(~mod(31), F.lit("</Report>")))
    doc = F.col("o_orderkey").cast("string")
    return o.select(doc.alias("doc_id"), F.concat(F.lit("report-"), doc, F.lit(".xml")).alias("package_name"), F.encode(text, "UTF-8").alias("content"))


def declarations(spark: SparkSession) -> DataFrame:
    """The schema of order documents."""
    rows = [
        ("#root", "Report", "ReportType", 1, 1, 1, None, None, None), ("ReportType", "Form", "Enum", 1, 1, 1, "F1", None, None), ("ReportType", "Status", "StatusEnum", 2, 1, 1, None, None, None),
        ("ReportType", "Date", "Date", 3, 1, 1, None, None, None), ("ReportType", "Cash", "Count", 4, 1, 1, None, "payment", "cash"), ("ReportType", "Loan", "Count", 4, 1, 1, None, "payment", "loan"),
        ("ReportType", "Size", "Count", 5, 1, 1, None, None, None), ("ReportType", "Line", "LineType", 6, 0, None, None, None, None),
        ("LineType", "Flag", "Enum", 1, 1, 1, None, None, None), ("LineType", "Part", "Count", 2, 1, 1, None, None, None),
    ]
    return spark.createDataFrame(rows, "owner string, name string, type_ref string, pos int, min_occurs int, max_occurs int, fixed string, choice_id string, branch string")


def declared_attributes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ReportType", "id", "required"), ("LineType", "n", "required")], "owner string, name string, use string")


def status_values(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("StatusEnum", v) for v in ("F", "O", "P")], "type_ref string, value string")


def facets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Count", "maxInclusive", "89"), ("Enum", "maxLength", "1")], "type_ref string, facet string, limit string")


def schema_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One schema file per brand: a simple type of its part types, a complex type per size over 40, arcroles by nation."""
    part = table(spark, sf_dir, "part")
    brand = F.regexp_replace("p_brand", "[^0-9]", "").alias("b")
    values = part.select(brand, "p_type").distinct().groupBy("b").agg(F.array_sort(F.collect_list("p_type")).alias("vs"))
    sizes = part.where("p_size > 40").select(brand, "p_size").distinct().groupBy("b").agg(F.array_sort(F.collect_list("p_size")).alias("ss"))
    one = lambda v: F.concat(F.lit('<xsd:enumeration value="'), v, F.lit('"><xsd:annotation><xsd:documentation> about '), v, F.lit(" </xsd:documentation></xsd:annotation></xsd:enumeration>\n"))
    enum = F.concat(F.lit('<xsd:simpleType name="Part_KindType"><xsd:restriction base="xsd:string">\n'), F.array_join(F.transform("vs", one), ""), F.lit("</xsd:restriction></xsd:simpleType>\n"))
    typ = lambda s: F.concat(F.lit('<xsd:complexType name="Size'), s.cast("string"), F.lit('Type"><xsd:complexContent><xsd:extension base="b:BaseType"><xsd:sequence><xsd:element name="Width" type="xsd:int" minOccurs="0"/></xsd:sequence></xsd:extension></xsd:complexContent></xsd:complexType>\n<xsd:element name="Box'), s.cast("string"), F.lit('" type="b:Size'), s.cast("string"), F.lit('Type"/>\n'))
    types = F.array_join(F.transform(F.coalesce("ss", F.array().cast("array<int>")), typ), "")
    arc = F.concat(F.lit('<xsd:simpleType name="ArcroleBase"><xsd:restriction base="xsd:string"><xsd:enumeration value="urn:x:brand'), "b", F.lit('/PART_IsMadeBy_BRAND"/></xsd:restriction></xsd:simpleType>\n'))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<!-- brand -->\n\n<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:brand:'), "b", F.lit('" xmlns:b="urn:brand:'), "b", F.lit('">\n'))
    text = F.concat(head, enum, types, arc, F.lit("</xsd:schema>\n"))
    rows = values.join(sizes, "b", "left")
    file = F.concat(F.lit("brand-"), "b", F.lit(".xsd"))
    return rows.select(file.alias("doc_id"), file.alias("file"), text.alias("text"), F.encode(text, "UTF-8").alias("content"))


SEVERITY = {"view": "info", "click": "warning", "error": "error", "signup": "critical"}


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings from events: the user is the package, purchases are no findings."""
    e = table(spark, sf_dir, "events")
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    day = F.date_format("ts", "yyyyMMdd")
    return e.where("event_type <> 'purchase'").select(
        F.col("event_id").cast("string").alias("finding_id"), F.concat_ws("-", F.col("user_id").cast("string"), day).alias("run_id"), F.col("user_id").cast("string").alias("doc_id"),
        F.col("ts").alias("created_at"), severity[F.col("event_type")].alias("severity"), (F.col("user_id") % 10).cast("string").alias("source"),
        F.when(F.col("user_id") % 3 == 0, "first").when(F.col("user_id") % 3 == 1, "second").otherwise("both").alias("investor"),
        F.concat_ws(":", "event_type", F.floor(F.col("value") / 10).cast("string")).alias("signature"),
    )


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per user and day."""
    e = table(spark, sf_dir, "events")
    count = lambda t: F.count_if(F.col("event_type") == t)
    out = e.groupBy(F.col("user_id").cast("string").alias("package_id"), F.date_format("ts", "yyyyMMdd").alias("d")).agg(F.max("ts").alias("created_at"), *[count(k).alias(v) for k, v in SEVERITY.items()])
    return out.select(
        F.concat_ws("-", "package_id", "d").alias("run_id"), "package_id", "created_at", *SEVERITY.values(), (F.col("info") + F.col("warning") + F.col("error") + F.col("critical")).alias("n_findings"),
        ((F.col("error") == 0) & (F.col("critical") == 0)).alias("passed"), (F.col("package_id").cast("long") % 10).cast("string").alias("source"),
        F.when(F.substring("d", 7, 2) <= "10", "1.0").when(F.substring("d", 7, 2) <= "20", "1.1").otherwise("1.2").alias("version"),
    )


def class_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations below regions below one root, as subclass axioms."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    none = F.lit(None).cast("string")
    row = lambda df, s, o: df.select(F.lit("tree").alias("graph_id"), s.alias("s"), F.lit(SUBCLASS).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang"))
    a = row(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_name"), F.col("r_name"))
    return a.unionByName(row(r, F.col("r_name"), F.lit("WORLD")))


def part_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, content``: a root schema per brand that includes one common file, which has no namespace of its own."""
    part = table(spark, sf_dir, "part").select(F.regexp_replace("p_brand", "[^0-9]", "").alias("b"), F.col("p_type").alias("t")).distinct()
    kinds = part.groupBy("b").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    listed = F.array_join(F.transform("ts", lambda t: F.concat(F.lit('<xs:enumeration value="'), t, F.lit('"/>'))), "")
    root = F.concat(
        F.lit('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:m="urn:brand:'), "b", F.lit('" targetNamespace="urn:brand:'), "b", F.lit('"><xs:include schemaLocation="./common/base.xsd"/>'),
        F.lit('<xs:element name="Part" type="m:PartType"/><xs:simpleType name="KindType"><xs:restriction base="m:ShortText">'), listed, F.lit("</xs:restriction></xs:simpleType>"),
        F.lit('<xs:complexType name="PartType"><xs:complexContent><xs:extension base="m:ThingType"><xs:sequence><xs:element name="Kind" type="m:KindType"/><xs:element name="Size" type="m:SizeType"/><xs:group ref="m:Price"/>'
              '<xs:choice minOccurs="0" maxOccurs="unbounded"><xs:element ref="m:Tag"/><xs:element name="Mark" type="xs:string"/></xs:choice></xs:sequence><xs:attributeGroup ref="m:Origin"/></xs:extension></xs:complexContent></xs:complexType></xs:schema>'),
    )
    files = kinds.select(F.concat(F.lit("brand-"), "b", F.lit(".xsd")).alias("doc_id"), root.alias("text"))
    common = spark.createDataFrame([("common/base.xsd", _COMMON)], "doc_id string, text string")
    return files.unionByName(common).select("doc_id", F.encode("text", "UTF-8").alias("content"))


_COMMON = """<x:schema xmlns:x="http://www.w3.org/2001/XMLSchema">
<x:simpleType name="ShortText"><x:restriction base="x:string"><x:maxLength value="24"/></x:restriction></x:simpleType>
<x:simpleType name="SizeType"><x:restriction base="x:int"><x:minInclusive value="1"/><x:maxInclusive value="40"/></x:restriction></x:simpleType>
<x:simpleType name="WhenType"><x:union memberTypes="x:gYear x:gYearMonth x:date"/></x:simpleType>
<x:simpleType name="UnitType"><x:restriction base="x:string"><x:enumeration value="kg"/><x:enumeration value="lb"/></x:restriction></x:simpleType>
<x:element name="Tag" type="ShortText"/>
<x:complexType name="ThingType"><x:sequence><x:element name="Id" type="x:int"/><x:element name="Made" type="WhenType" minOccurs="0"/></x:sequence><x:attribute name="k" type="x:int" use="required"/></x:complexType>
<x:group name="Price"><x:choice><x:element name="Retail" type="AmountType"/><x:element name="Free"><x:complexType/></x:element></x:choice></x:group>
<x:complexType name="AmountType"><x:simpleContent><x:extension base="x:decimal"><x:attribute name="cur" type="x:string" fixed="EUR"/></x:extension></x:simpleContent></x:complexType>
<x:attributeGroup name="Origin"><x:attribute name="unit" type="UnitType"/><x:attributeGroup ref="Trace"/></x:attributeGroup>
<x:attributeGroup name="Trace"><x:attribute name="lot" type="ShortText"/></x:attributeGroup>
</x:schema>"""


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, set_id, content``: a document per part, with defects by residue, to be checked against its brand's schema."""
    p = table(spark, sf_dir, "part")
    mod = lambda n: F.col("p_partkey") % n == 0
    key = F.col("p_partkey").cast("string")
    el = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    opt = lambda cond, c: F.when(cond, c).otherwise("")
    kind, size = el("Kind", F.when(mod(43), F.lit("NO SUCH KIND")).otherwise(F.col("p_type"))), el("Size", F.col("p_size").cast("string"))
    retail = F.concat(F.lit("<Retail"), F.when(mod(47), F.lit(' cur="USD"')).otherwise(F.lit(' cur="EUR"')), F.lit(">"), F.when(mod(53), F.lit("cheap")).otherwise(F.lit("12.50")), F.lit("</Retail>"))
    body = F.concat(
        opt(~mod(31), el("Id", key)), opt(mod(2), el("Made", F.when(mod(29), F.lit("2024-13")).when(mod(4), F.lit("2024")).otherwise("2024-02"))), F.when(mod(17), F.concat(size, kind)).otherwise(F.concat(opt(~mod(11), kind), size)),
        retail, opt(mod(19), F.lit("<Free/>")), opt(mod(13), F.lit("<Extra><Deep/></Extra>")), opt(mod(3), F.lit("<Tag>a</Tag><Mark>b</Mark><Tag>c</Tag>")),
    )
    head = F.concat(F.lit('<Part unit="'), F.when(mod(37), F.lit("st")).otherwise("kg"), F.lit('"'), opt(~mod(41), F.concat(F.lit(' k="'), opt(mod(23), F.lit("x")), key, F.lit('"'))), opt(mod(59), F.lit(' odd="1"')), F.lit(">"))
    return p.select(key.alias("doc_id"), F.concat(F.lit("brand-"), F.regexp_replace("p_brand", "[^0-9]", ""), F.lit(".xsd")).alias("set_id"), F.encode(F.concat(head, body, F.lit("</Part>")), "UTF-8").alias("content"))


def ledger_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, content``: a root schema per order priority that includes a common file of moves, which stand for an abstract one."""
    one = F.substring("o_orderpriority", 1, 1)
    text = F.concat(
        F.lit('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:m="urn:ledger:'), one, F.lit('" targetNamespace="urn:ledger:'), one, F.lit('"><xs:include schemaLocation="moves.xsd"/><xs:element name="Account"><xs:complexType><xs:sequence>'
              '<xs:element ref="m:Move"/><xs:element name="Code" type="m:CodeType"/><xs:element name="Holder" type="m:Party" minOccurs="0"/><xs:element ref="m:Fee" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element></xs:schema>'),
    )
    roots = table(spark, sf_dir, "orders").select(F.concat(F.lit("ledger-"), one, F.lit(".xsd")).alias("doc_id"), text.alias("text")).distinct()
    common = spark.createDataFrame([("moves.xsd", _MOVES)], "doc_id string, text string")
    return roots.unionByName(common).select("doc_id", F.encode("text", "UTF-8").alias("content"))


_MOVES = """<x:schema xmlns:x="http://www.w3.org/2001/XMLSchema">
<x:element name="Move" type="x:decimal" abstract="true"/><x:element name="Debit" substitutionGroup="Move"/><x:element name="Credit" substitutionGroup="Move" abstract="true"/><x:element name="Reversal" substitutionGroup="Credit"/>
<x:element name="Fee" type="x:int" abstract="true"/><x:element name="WireFee" substitutionGroup="Fee"/>
<x:complexType name="Party" abstract="true"><x:sequence/></x:complexType>
<x:simpleType name="Letter"><x:restriction base="x:string"><x:enumeration value="A"/><x:enumeration value="B"/></x:restriction></x:simpleType>
<x:simpleType name="CodeType"><x:union memberTypes="Letter"><x:simpleType><x:restriction base="x:int"><x:maxInclusive value="99"/></x:restriction></x:simpleType></x:union></x:simpleType>
</x:schema>"""


def ledger_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, set_id, content``: a document per order, with defects by residue, to be checked against its priority's schema."""
    o = table(spark, sf_dir, "orders")
    mod = lambda n: F.col("o_orderkey") % n == 0
    opt = lambda cond, c: F.when(cond, c).otherwise("")
    el = lambda name, c: F.concat(F.lit("<"), name, F.lit(">"), c, F.lit("</"), name, F.lit(">"))
    move = F.when(mod(5), F.lit("Move")).when(mod(3), F.lit("Reversal")).otherwise(F.lit("Debit"))
    code = F.when(mod(13), "C").when(mod(17), "100").when(mod(2), "A").otherwise("42")
    holder = F.when(mod(29), "<Holder/>").when(mod(31), '<Holder xmlns:i="http://www.w3.org/2001/XMLSchema-instance" i:type="Person"/>').otherwise("")
    body = F.concat(opt(~mod(7), el(move, F.when(mod(11), "much").otherwise("1.50"))), el(F.lit("Code"), code), holder, opt(mod(19), F.lit("<WireFee>1</WireFee><WireFee>2</WireFee>")), opt(mod(23), F.lit("<Fee>3</Fee>")))
    set_id = F.concat(F.lit("ledger-"), F.substring("o_orderpriority", 1, 1), F.lit(".xsd"))
    return o.select(F.col("o_orderkey").cast("string").alias("doc_id"), set_id.alias("set_id"), F.encode(F.concat(F.lit("<Account>"), body, F.lit("</Account>")), "UTF-8").alias("content"))


def nested_graph(spark: SparkSession, sf_dir: str, by_graph: bool = False) -> DataFrame:
    """Per order a chain of ten nodes, the last of which holds a value, and a ring of three peers, one of which may lack a tag; dealt as
    those of ``star_graph``."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("graph_id"), "o_orderkey", "o_custkey")
    o = o.repartition(_tasks(o), "graph_id") if by_graph else o
    key = F.col("graph_id")
    n = lambda i: F.lit(f"n{i}")
    ring = [(None, F.lit(f"p{i}"), T + "peer", F.lit(f"p{(i + 1) % 3}"), "iri", None) for i in range(3)] + [(None, F.lit(f"p{i}"), TYPE, F.lit(T + "Peer"), "iri", None) for i in range(3)]
    tags = [(F.col("o_orderkey") % 5 != 0 if i == 2 else None, F.lit(f"p{i}"), T + "tag", F.lit("x"), "literal", None) for i in range(3)]
    kind = F.when(F.col("o_orderkey") % 3 == 0, "2024").when(F.col("o_orderkey") % 3 == 1, "2024-02-01").otherwise("soon")
    return _triples(o, key, _facts([
        (None, n(0), TYPE, F.lit(T + "Chain"), "iri", None), *[(None, n(i), T + "next", n(i + 1), "iri", None) for i in range(9)], (None, n(9), T + "size", F.col("o_custkey") % 100, "literal", XSD + "int"),
        *ring, *tags, (None, n(0), T + "made", kind, "literal", None), (F.col("o_orderkey") % 4 == 0, n(0), T + "cash", F.lit("1"), "literal", None), (F.col("o_orderkey") % 7 == 0, n(0), T + "loan", F.lit("1"), "literal", None),
    ]))


def nested_shapes(spark: SparkSession) -> DataFrame:
    """Ten shapes that name each other in a row, one that names itself, a union of two patterns and a choice of two properties."""
    rows = [(f"S{i}", "Chain" if i == 0 else f"None{i}", "next", "node", f"S{i + 1}", None, None) for i in range(9)] + [("S9", "None9", "size", "maxInclusive", "89", None, None)]
    rows += [("Ring", "Peer", "peer", "node", "Ring", None, None), ("Ring", "Peer", "tag", "minCount", "1", None, None)]
    rows += [("S0", "Chain", "made", "pattern", p, "when", b) for b, p in (("year", "^[0-9]{4}$"), ("date", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))]
    rows += [("S0", "Chain", b, "minCount", "1", "payment", b) for b in ("cash", "loan")]
    return spark.createDataFrame([(s, T + c, T + p, k, v, "violation", g, b) for s, c, p, k, v, g, b in rows], "shape string, target_class string, path string, kind string, value string, severity string, group_id string, branch string")


def schema_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of the session with one schema file per brand (25 names)."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    schema_documents(spark, sf_dir).select("file", "text").repartition("file").write.partitionBy("file").text(path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in fs.globStatus(at(f"{path}/file=*/part-*")):
        found = part.getPath()
        fs.rename(found, at(f"{path}/{found.getParent().getName().removeprefix('file=')}"))
        fs.delete(found.getParent(), True)
    return path
