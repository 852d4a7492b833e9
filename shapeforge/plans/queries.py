"""One query per operator or small group of operators, over the driver's tables, each with the SQL of its expected rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import conform, findings, graphs, history, lint, measure, project, registry, resolve, schema, shapes, vocab
from ..operators.fixpoint import shared_folder, stored
from ..schemas import OWL, RDFS, SKOS, XSD
from ..sources import documents as src
from ..sources import shred
from ..streaming import intake
from . import stand_ins as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
T = st.T
_B = "regexp_replace(p_brand, '[^0-9]', '', 'g')"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _short(c):
    """A term's local name."""
    return F.regexp_replace(c, "^.*#", "")


# ---- shapes (SHP, GRF4, MEA) ---------------------------------------------------------------------------------------

ORDERS = "orders JOIN customer ON o_custkey = c_custkey"
_BAD = f"""
  SELECT o_orderkey k, 'order-' || o_orderkey focus, 'AppraisalShape' shape, 'appraisesProperty' path, 'class' component, 'cust-' || o_custkey AS value FROM {ORDERS} WHERE o_orderkey % 13 = 0
  UNION ALL SELECT o_orderkey, 'order-' || o_orderkey, 'AppraisalShape', 'hasOpinionOfValue', 'minCount', NULL FROM {ORDERS} WHERE o_orderkey % 7 = 0
  UNION ALL SELECT o_orderkey, 'order-' || o_orderkey, 'AppraisalShape', 'usesValuationApproach', 'minCount', NULL FROM {ORDERS} WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT o_orderkey, 'order-' || o_orderkey, 'AppraisalShape', 'hasReconciliation', 'maxCount', NULL FROM {ORDERS} WHERE o_orderkey % 11 = 0
  UNION ALL SELECT o_orderkey, 'cust-' || o_custkey, 'SubjectPropertyShape', 'hasPropertyConditionRating', 'minCount', NULL FROM {ORDERS} WHERE o_orderkey % 13 <> 0 AND NOT c_acctbal > 0
  UNION ALL SELECT o_orderkey, 'cust-' || o_custkey, 'SubjectPropertyShape', 'hasPropertyQualityRating', 'minCount', NULL FROM {ORDERS} WHERE o_orderkey % 13 <> 0 AND c_mktsegment = 'BUILDING'"""


def _validated(spark, sf_dir):
    triples, ontology, rows = st.star_graph(spark, sf_dir, by_graph=True), st.ontology(spark), st.shapes(spark)
    return triples, ontology, rows, shapes.validate_shapes(triples, rows, ontology)


@query(f"SELECT k::VARCHAR AS graph_id, focus, shape, path, component, value FROM ({_BAD})")
def shp_results(spark, sf_dir):
    """SHP1-4, SHP6, GRF4: every violation of the star graphs."""
    *_, results = _validated(spark, sf_dir)
    return results.select("graph_id", "focus", "shape", _short(F.col("path")).alias("path"), "component", "value")


@query(f"SELECT o_orderkey::VARCHAR AS graph_id, count(b.k) AS n_violations, count(b.k) = 0 AS conforms FROM {ORDERS} LEFT JOIN ({_BAD}) b ON b.k = o_orderkey GROUP BY 1")
def shp_conforms(spark, sf_dir):
    """SHP7."""
    triples, _, _, results = _validated(spark, sf_dir)
    return shapes.conforms(triples.where(F.col("o") == T + "Appraisal"), results)


@query(f"""SELECT shape, path, CASE component WHEN 'class' THEN CASE WHEN EXISTS (SELECT 1 FROM customer c WHERE 'cust-' || c_custkey = value AND (c_acctbal > 0 OR c_mktsegment <> 'BUILDING')) THEN 'untyped' ELSE 'absent' END
  WHEN 'minCount' THEN 'predicate-missing' ELSE 'predicate-cardinality' END AS defect, count(*) AS n FROM ({_BAD}) GROUP BY ALL""")
def shp_defects(spark, sf_dir):
    """SHP8: a customer without a type is untyped where it has a rating, absent where it has no triple."""
    triples, ontology, rows, results = _validated(spark, sf_dir)
    out = shapes.classify_defects(results, triples, rows, graphs.subclass_closure(ontology))
    return out.groupBy("shape", _short(F.col("path")).alias("path"), "defect").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN path = 'hasOpinionOfValue' THEN 'R-OPINION' END AS rule_id, 'error' AS severity, CASE WHEN path = 'hasOpinionOfValue' THEN 'one opinion of value' WHEN component = 'class' THEN 'value is not a {T}SubjectProperty' WHEN component = 'minCount' THEN 'fewer than 1 values' ELSE 'more than 1 values' END AS expected_condition, count(*) AS n FROM ({_BAD}) GROUP BY ALL")
def shp_findings(spark, sf_dir):
    """SHP9: results as findings, one rule known."""
    *_, results = _validated(spark, sf_dir)
    rules = spark.createDataFrame([("AppraisalShape", T + "hasOpinionOfValue", "minCount", "R-OPINION", "one opinion of value")], "shape string, path string, component string, rule_id string, expected_condition string")
    return shapes.shape_findings(results, rules).groupBy("rule_id", "severity", "expected_condition").agg(F.count("*").alias("n"))


@query(f"""SELECT path, component, count(*) AS n FROM (
  SELECT 'status' path, 'in' component FROM {ORDERS} WHERE o_orderstatus NOT IN ('F', 'O')
  UNION ALL SELECT 'priority', 'pattern' FROM {ORDERS} WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-') UNION ALL SELECT 'priority', 'maxLength' FROM {ORDERS} WHERE length(o_orderpriority) > 10
  UNION ALL SELECT 'size', 'maxInclusive' FROM {ORDERS} WHERE o_custkey % 100 > 89 UNION ALL SELECT 'size', 'minInclusive' FROM {ORDERS} WHERE o_custkey % 100 < 5
  UNION ALL SELECT 'usesValuationApproach', 'or' FROM (SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL HAVING max(l_returnflag IN ('R', 'A')) = false)
  UNION ALL SELECT 'appraisesProperty', 'node' FROM {ORDERS} WHERE o_orderkey % 13 <> 0 AND (NOT c_acctbal > 0 OR c_mktsegment = 'BUILDING')) GROUP BY ALL""")
def shp_values(spark, sf_dir):
    """SHP5: datatype, length, range, pattern, in, or, node."""
    triples, ontology, base, results = _validated(spark, sf_dir)
    closure = graphs.subclass_closure(ontology)
    rows = st.value_shapes(spark)
    out = shapes.value_constraints(triples, None, rows, closure, results, shapes.target_values(triples, rows, closure))
    return out.groupBy(_short(F.col("path")).alias("path"), "component").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey::VARCHAR AS graph_id, focus, component, value FROM (
  SELECT o_orderkey, 'n0' AS focus, 'node' AS component, 'n1' AS value FROM orders WHERE o_custkey % 100 > 89 UNION ALL SELECT o_orderkey, 'n0', 'or', 'soon' FROM orders WHERE o_orderkey % 3 = 2
  UNION ALL SELECT o_orderkey, 'n0', 'or', NULL FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 0
  UNION ALL SELECT o_orderkey, f, c, v FROM orders, (VALUES ('p2', 'minCount', NULL), ('p2', 'node', 'p0'), ('p1', 'node', 'p2'), ('p0', 'node', 'p1')) t(f, c, v) WHERE o_orderkey % 5 = 0)""")
def shp_nested(spark, sf_dir):
    """SHP5-6: node shapes ten deep and in a ring, alternatives of a value's patterns and of properties."""
    results = shapes.validate_shapes(st.nested_graph(spark, sf_dir, by_graph=True), st.nested_shapes(spark), st.ontology(spark))
    return results.select("graph_id", "focus", "component", "value")


@query(f"""SELECT o_orderkey::VARCHAR AS graph_id, component, severity, n_violations = 0 AS conforms FROM (
  SELECT o_orderkey, 'maxCount' AS component, 'warning' AS severity, 0 AS n_violations FROM {ORDERS} WHERE o_orderkey % 11 = 0
  UNION ALL SELECT o_orderkey, 'minCount', 'info', 0 FROM {ORDERS} WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT o_orderkey, 'minCount', 'violation', 1 FROM {ORDERS} WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT o_orderkey, 'minInclusive', 'violation', 1 FROM {ORDERS} WHERE o_orderdate < DATE '1995-06-17') x
  WINDOW w AS (PARTITION BY o_orderkey)""".replace("n_violations = 0 AS conforms", "sum(n_violations) OVER w = 0 AS conforms"))
def shp_severities(spark, sf_dir):
    """SHP2-3, SHP5, SHP7: limits of several severities on one path, dates in order; only violations count."""
    triples, none = st.star_graph(spark, sf_dir), F.lit(None).cast("string")
    dates = st.table(spark, sf_dir, "orders").join(st.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("graph_id"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("s"), F.lit(T + "date").alias("p"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o"), F.lit("literal").alias("o_kind"), F.lit(XSD + "date").alias("o_datatype"), none.alias("o_lang"),
    )
    rows = [("hasReconciliation", "maxCount", "1", "warning"), ("hasReconciliation", "minCount", "2", "info"), ("hasReconciliation", "minCount", "1", "violation"), ("usesValuationApproach", "minCount", "1", "violation"), ("date", "minInclusive", "1995-06-17", "violation")]
    rows = spark.createDataFrame([("S", T + "Appraisal", T + p, k, v, sev) for p, k, v, sev in rows], "shape string, target_class string, path string, kind string, value string, severity string")
    results = shapes.validate_shapes(triples.unionByName(dates), rows, st.ontology(spark))
    verdict = shapes.conforms(triples.where(F.col("o") == T + "Appraisal"), results)
    return results.join(verdict, "graph_id").select("graph_id", "component", "severity", "conforms")


@query("SELECT 'part-' || a.k AS sub, 'part-' || b.k AS super FROM (SELECT DISTINCT p_size AS k FROM part) a, (SELECT DISTINCT p_size AS k FROM part) b WHERE a.k <= b.k")
def grf_chain(spark, sf_dir):
    """GRF4 by joins: the sizes of parts as one chain of subclasses."""
    sizes = st.table(spark, sf_dir, "part").select(F.col("p_size").alias("k")).distinct()
    above = sizes.alias("a").join(sizes.alias("b"), F.col("b.k") > F.col("a.k")).groupBy(F.col("a.k").alias("k")).agg(F.min("b.k").alias("up"))
    name = lambda c: F.concat(F.lit("part-"), F.col(c).cast("string"))
    axioms = above.select(F.lit("chain").alias("graph_id"), name("k").alias("s"), F.lit(graphs.SUBCLASS).alias("p"), name("up").alias("o"))
    return graphs.subclass_closure(axioms, local_pairs=0)


def _counts(spark, sf_dir):
    triples, rows = st.star_graph(spark, sf_dir), st.shapes(spark)
    focus = shapes.focus_nodes(triples, rows, graphs.subclass_closure(st.ontology(spark)))
    return shapes.property_counts(triples, focus, rows)


_PAIRS = f"""SELECT o_orderkey k, 'appraisesProperty' path, true ok FROM {ORDERS} UNION ALL SELECT o_orderkey, 'hasOpinionOfValue', o_orderkey % 7 <> 0 FROM {ORDERS}
  UNION ALL SELECT o_orderkey, 'usesValuationApproach', o_orderkey IN (SELECT l_orderkey FROM lineitem) FROM {ORDERS} UNION ALL SELECT o_orderkey, 'hasReconciliation', true FROM {ORDERS}
  UNION ALL SELECT o_orderkey, 'hasPropertyConditionRating', c_acctbal > 0 FROM {ORDERS} WHERE o_orderkey % 13 <> 0 UNION ALL SELECT o_orderkey, 'hasPropertyQualityRating', c_mktsegment <> 'BUILDING' FROM {ORDERS} WHERE o_orderkey % 13 <> 0"""


@query(f"SELECT k::VARCHAR AS graph_id, count(*) FILTER (ok) AS satisfied, count(*) AS required, round(count(*) FILTER (ok) / count(*), 9) AS completeness FROM ({_PAIRS}) GROUP BY k")
def mea_completeness(spark, sf_dir):
    """MEA1."""
    return measure.completeness(_counts(spark, sf_dir)).withColumn("completeness", F.round("completeness", 9))


@query(f"SELECT path, count(*) AS evaluated, count(*) FILTER (NOT ok) AS failed, round((count(*) - count(*) FILTER (NOT ok)) / count(*), 9) AS pass_rate FROM ({_PAIRS}) GROUP BY path")
def mea_rule_compliance(spark, sf_dir):
    """MEA5."""
    counts = _counts(spark, sf_dir).where("least > 0").withColumn("path", _short(F.col("path")))
    return measure.rule_compliance(counts, counts.where("n_values < least"), ["path"]).withColumn("pass_rate", F.round("pass_rate", 9))


@query("SELECT 'cust-' || o_custkey AS s, 'hasPropertyConditionRating' AS p, count(*) AS n_values FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY o_custkey HAVING count(*) > 1")
def mea_consistency(spark, sf_dir):
    """MEA2: a customer rated by several orders."""
    out = measure.consistency(st.star_graph(spark, sf_dir), [T + "hasPropertyConditionRating"])
    return out.select("s", _short(F.col("p")).alias("p"), "n_values")


@query("SELECT count(*) AS n, count(*) AS n_covered, 1.0::DOUBLE AS coverage FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')")
def mea_evidence(spark, sf_dir):
    """MEA3: sales comparison approaches with a comparable."""
    return measure.evidence_coverage(st.star_graph(spark, sf_dir), T + "SalesComparisonApproach", T + "usesComparableSale")


@query("""WITH c AS (SELECT o_orderkey, count(DISTINCT l_partkey) n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY 1)
  SELECT count(*) AS n_reports, min(n) AS least, max(n) AS most, quantile_cont(n, 0.25)::DOUBLE AS q1, quantile_cont(n, 0.5)::DOUBLE AS median, quantile_cont(n, 0.75)::DOUBLE AS q3 FROM c""")
def mea_comparables(spark, sf_dir):
    """MEA4: distribution."""
    triples = st.star_graph(spark, sf_dir)
    return measure.comparable_distribution(triples, T + "usesComparableSale", triples.where(F.col("o") == T + "Appraisal"))


@query("SELECT 'part-' || l_partkey AS comparable, count(DISTINCT l_orderkey) AS n_reports FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey ORDER BY 2 DESC, 1 LIMIT 10")
def mea_most_reused(spark, sf_dir):
    """MEA4: top ten."""
    return measure.most_reused_comparables(st.star_graph(spark, sf_dir), T + "usesComparableSale", 10)


# ---- graphs (GRF) --------------------------------------------------------------------------------------------------

_N = "(SELECT o_orderkey k, count(DISTINCT l_linenumber) n, count(DISTINCT (l_linenumber, l_returnflag)) t, count(DISTINCT (l_linenumber, l_partkey)) FILTER (l_returnflag = 'R') c FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)"


@query(f"""SELECT o_orderkey::VARCHAR AS graph_id, (7 + CASE WHEN o_orderkey % 13 <> 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 7 <> 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 0 END
  + CASE WHEN c_acctbal > 0 THEN 2 ELSE 0 END + CASE WHEN c_mktsegment <> 'BUILDING' THEN 2 ELSE 0 END + CASE WHEN n > 0 THEN n + t + c ELSE 0 END)::BIGINT AS n_triples, false AS is_empty FROM {ORDERS} JOIN {_N} ON k = o_orderkey""")
def grf_sizes(spark, sf_dir):
    """GRF5."""
    return graphs.graph_sizes(st.star_graph(spark, sf_dir))


@query("SELECT o_orderkey::VARCHAR AS graph_id, CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END::BIGINT AS n_focus, o_orderkey % 11 <> 0 AS ok FROM orders")
def grf_focus_count(spark, sf_dir):
    """GRF6: reconciliations per graph."""
    return graphs.focus_count_check(st.star_graph(spark, sf_dir), T + "Reconciliation", 1)


@query(f"SELECT o_orderkey::VARCHAR AS graph_id, 'order-' || o_orderkey AS s, 'cust-' || o_custkey AS o, CASE WHEN o_orderkey % 13 = 0 THEN 'first' WHEN o_orderkey % 11 = 0 THEN 'second' ELSE 'shared' END AS side FROM {ORDERS} WHERE NOT (o_orderkey % 13 = 0 AND o_orderkey % 11 = 0)")
def grf_diff(spark, sf_dir):
    """GRF3: two versions of the property facts, every triple with its side."""
    facts = graphs.match(st.star_graph(spark, sf_dir), p=T + "appraisesProperty")
    key = F.col("graph_id").cast("long")
    return graphs.graph_diff(facts.where(key % 11 != 0), facts.where(key % 13 != 0)).select("graph_id", "s", "o", "side")


@query(f"SELECT o_orderkey::VARCHAR AS graph_id, 'order-' || o_orderkey AS s, 'cust-' || o_custkey AS o FROM {ORDERS}")
def grf_merge(spark, sf_dir):
    """GRF1: set union of two graphs that overlap and hold all orders together."""
    facts = graphs.match(st.star_graph(spark, sf_dir), p=T + "appraisesProperty")
    key = F.col("graph_id").cast("long")
    return graphs.merge_graphs(facts.where(key % 3 != 0), facts.where((key % 2 == 0) | (key % 3 == 0))).select("graph_id", "s", "o")


@query("SELECT o_orderkey::VARCHAR AS graph_id, 'order-' || o_orderkey AS s FROM orders WHERE o_orderstatus = 'P'")
def grf_match(spark, sf_dir):
    """GRF2: pattern and batch membership."""
    triples = st.star_graph(spark, sf_dir)
    hits = graphs.match(triples, p=T + "status", o="P")
    # subjects are asked for, so each is one row before it meets the hits
    return graphs.match_many(triples.select("graph_id", "s").distinct(), hits, ["graph_id", "s"])


@query("""SELECT n_name AS sub, n_name AS super FROM nation UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, r_name FROM region
  UNION SELECT n_name, 'WORLD' FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'WORLD' FROM region UNION SELECT 'WORLD', 'WORLD'""")
def grf_closure(spark, sf_dir):
    """GRF4 on nations, regions and the world."""
    return graphs.subclass_closure(st.class_tree(spark, sf_dir))


@query("SELECT 'opinion-' || o_orderkey AS s FROM orders WHERE o_orderkey % 7 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
def lnt_missing_terms(spark, sf_dir):
    """LNT2: opinions that no graph declares, of those that each order should have."""
    wanted = st.table(spark, sf_dir, "orders").select(F.concat(F.lit("opinion-"), F.col("o_orderkey").cast("string")).alias("term"), F.lit(T + "OpinionOfValue").alias("cls"))
    return lint.missing_terms(st.star_graph(spark, sf_dir), wanted).select(F.col("term").alias("s"))


# ---- documents (DOC, SRC, SNK) -------------------------------------------------------------------------------------


@query("SELECT conv_id || '-' || turn AS doc_id, 'error' AS severity, '/' AS data_location FROM conversations WHERE text IS NULL OR NOT starts_with(regexp_replace(text, '^\\s+', ''), '<') UNION ALL SELECT page_id::VARCHAR, 'error', '/' FROM pages WHERE html IS NULL OR NOT starts_with(regexp_replace(html, '^\\s+', ''), '<')")
def doc_unreadable(spark, sf_dir):
    """SRC3, DOC1: conversations are no packages, pages look like some."""
    a = st.table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    b = st.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("html").alias("text"))
    return shred.unreadable_packages(src.packages_from_table(a.unionByName(b), "id", "text")).select("doc_id", "severity", "data_location")


_DOCS = "(SELECT o.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines, (o_orderkey % 31 <> 0) AS fine FROM orders o)"
_CHOICE = "CASE WHEN o_orderkey % 59 = 0 THEN 0 WHEN o_orderkey % 53 = 0 THEN 2 ELSE 1 END"
_STATUS = "CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE 1 END"
_DATES = "CASE WHEN o_orderkey % 41 = 0 THEN 2 ELSE 1 END"
_EXTRA = "CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END"


def _typed(spark, sf_dir, *columns):
    """Typed elements of the orders' documents, with the columns that a check looks at."""
    return _typed_of(st.order_documents(spark, sf_dir), *columns)


def _typed_of(documents, *columns):
    rows = shred.shredded(documents, ("doc_id", "kind", "depth", "local_name", "path", "bare_path", *columns)).where("kind = 'element'")
    return conform.typed_elements(rows.drop("kind"), st.declarations(documents.sparkSession), max_depth=2)


def _named(schema_table, column):
    """What a column of a schema table names."""
    return {r[0] for r in schema_table.select(column).distinct().collect()}


#: Columns of the checks of values and of children.
_FOR_VALUES, _FOR_CHILDREN = ("n_children", "text"), ("children",)


@query(f"SELECT o_orderkey::VARCHAR AS doc_id, (3 + {_STATUS} + {_DATES} + {_CHOICE} + {_EXTRA} + 3 * n_lines)::BIGINT AS n_elements, (1 + CASE WHEN o_orderkey % 47 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 43 = 0 THEN 0 ELSE n_lines END)::BIGINT AS n_attributes, CASE WHEN n_lines > 0 THEN 2 ELSE 1 END::INTEGER AS depth FROM {_DOCS} WHERE fine")
def doc_shred(spark, sf_dir):
    """DOC2."""
    rows = shred.shredded(st.order_documents(spark, sf_dir), ("doc_id", "kind", "depth", "attrs")).where("kind = 'element'")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_elements"), F.sum(F.size("attrs")).alias("n_attributes"), F.max("depth").alias("depth"))


@query("SELECT o_orderkey::VARCHAR AS doc_id, 'error' AS severity, '/' AS data_location, 1 AS col FROM orders WHERE o_orderkey % 31 = 0")
def doc_parse_findings(spark, sf_dir):
    """DOC3: a cut-off document has one finding, at column 1 behind its last newline."""
    return shred.parse_findings(shred.unparsed(st.order_documents(spark, sf_dir))).select("doc_id", "severity", "data_location", "col")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)::INTEGER AS sibling_index FROM events")
def doc_sibling_index(spark, sf_dir):
    """DOC4: events as children of their users."""
    return shred.with_sibling_index(st.table(spark, sf_dir, "events"), "user_id", "user_id", "event_type", "event_id").select("event_id", "sibling_index")


@query("SELECT p_partkey, '/Parts[1]/' || p_type || '[' || p_size || ']/Name[1]' AS path, 3 AS n_ancestors, '/Parts[1]' AS top, p_brand AS local FROM part")
def doc_paths(spark, sf_dir):
    """DOC5-7."""
    p = st.table(spark, sf_dir, "part")
    raw = F.concat(F.lit("/{urn:a/b}Parts/x:"), "p_type", F.lit("["), F.col("p_size").cast("string"), F.lit("]/Name"))
    d = p.withColumn("path", S.normalize_path(raw)).withColumn("up", S.ancestor_paths(F.col("path")))
    return d.select("p_partkey", "path", F.size("up").alias("n_ancestors"), F.element_at("up", -1).alias("top"), S.local_name(F.concat(F.lit("{urn:x}"), "p_brand")).alias("local"))


@query(f"SELECT 'order-' || o_orderkey AS s, 'cust-' || o_custkey AS o, 'iri' AS o_kind FROM {ORDERS} UNION ALL SELECT 'order-' || o_orderkey, o_orderpriority, 'literal' FROM {ORDERS}")
def src_triples(spark, sf_dir):
    """SRC4, SNK1: triples to N-Triples text and back."""
    facts = st.star_graph(spark, sf_dir).where(F.col("p").isin(T + "appraisesProperty", T + "priority"))
    lines = src.triple_lines(facts).withColumn("graph_id", F.lit("g"))
    return src.parse_ntriples(lines).select("s", "o", "o_kind")


@query(f"""SELECT 'order-' || o_orderkey AS s, 'appraisesProperty' AS p, 'cust-' || o_custkey AS o, o_orderkey::VARCHAR AS graph_id FROM {ORDERS} UNION ALL SELECT 'order-' || o_orderkey, 'priority', o_orderpriority, o_orderkey::VARCHAR FROM {ORDERS}
  UNION ALL SELECT DISTINCT 'line-' || l_orderkey || '-' || l_linenumber, 'type', CASE l_returnflag WHEN 'R' THEN 'SalesComparisonApproach' WHEN 'A' THEN 'CostApproach' ELSE 'IncomeApproach' END, l_orderkey::VARCHAR FROM lineitem""")
def snk_triples(spark, sf_dir):
    """SNK1: triples written in clustered folders per predicate and read back, the many types over several files."""
    wanted = F.col("p").isin(T + "appraisesProperty", T + "priority") | ((F.col("p") == st.TYPE) & F.col("s").startswith("line-"))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    src.write_triples(st.star_graph(spark, sf_dir).where(wanted), path, "parquet", file_rows=10_000)
    back = spark.read.parquet(path)
    return back.select("s", _short(F.col("p")).alias("p"), F.when(F.col("o_kind") == "iri", _short(F.col("o"))).otherwise(F.col("o")).alias("o"), F.col("graph_id").cast("string").alias("graph_id"))


@query(f"SELECT 'brand-' || {_B} || '.xsd' AS package_name, count(DISTINCT p_type) + 1 AS n FROM part GROUP BY 1")
def src_documents(spark, sf_dir):
    """SRC1: files of a folder as packages."""
    found = src.read_documents(spark, st.schema_folder(spark, sf_dir))
    return found.select("package_name", F.size(F.split(F.decode("content", "UTF-8"), "<xsd:enumeration ")).cast("long").alias("parts")).select("package_name", (F.col("parts") - 1).alias("n"))


@query(f"SELECT 'brand-' || b || '.xsd' AS file, true AS ok, row_number() OVER (ORDER BY b)::INTEGER AS place FROM (SELECT DISTINCT {_B} AS b FROM part)")
def src_schema_files(spark, sf_dir):
    """SRC2: the schema files of a folder in order of name."""
    files = src.read_schema_files(spark, st.schema_folder(spark, sf_dir))
    heads = schema.schema_headers(files).select("file", "ok")
    return heads.withColumn("place", F.row_number().over(Window.orderBy("file")))  # one row a file of a folder


@query(f"SELECT o_orderkey::VARCHAR AS doc_id, status, n AS n_embedded, n AS finding_count FROM (SELECT o_orderkey, ({_EXTRA})::BIGINT AS n, CASE WHEN o_orderkey % 19 = 0 THEN 'failed' ELSE 'passed' END AS status FROM {_DOCS} WHERE fine) UNION ALL SELECT o_orderkey::VARCHAR, 'failed', 1, 1 FROM {_DOCS} WHERE NOT fine")
def snk_reports(spark, sf_dir):
    """SNK2: nested report records."""
    docs = st.order_documents(spark, sf_dir)
    found, _ = stored(_with_place(conform.unknown_elements(_typed(spark, sf_dir)), docs).unionByName(shred.parse_findings(shred.unparsed(docs))))
    nested = src.nested_reports(findings.schema_reports(docs, found), found)
    return nested.select("doc_id", "status", F.size("findings").cast("long").alias("n_embedded"), "finding_count")


def _with_place(found, docs):
    """Findings with their places: only documents with findings are parsed for them."""
    found, _ = stored(found)
    rows = shred.shredded(docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi"), ("doc_id", "kind", "path", "line", "col"))
    out = conform.locate_findings(found, shred.elements(rows))
    return out.select("doc_id", "severity", "message", "line", "col", "error_code", "data_location")


# ---- conformance (CON) ---------------------------------------------------------------------------------------------


def _out(found, *cols):
    return found.select("doc_id", "data_location", *cols)


@query(f"SELECT o_orderkey::VARCHAR AS doc_id, '/Report[1]/Extra[1]' AS data_location, 'Extra' AS observed_value FROM {_DOCS} WHERE fine AND o_orderkey % 19 = 0")
def con_unknown(spark, sf_dir):
    """CON1."""
    return _out(conform.unknown_elements(_typed(spark, sf_dir)), "observed_value")


@query(f"SELECT o_orderkey::VARCHAR AS doc_id, '/Report[1]' AS data_location, 'Missing element Status' AS message FROM {_DOCS} WHERE fine AND o_orderkey % 17 = 0")
def con_missing(spark, sf_dir):
    """CON2."""
    return _out(conform.missing_elements(_typed(spark, sf_dir, *_FOR_CHILDREN), st.declarations(spark)), "message")


@query(f"SELECT o_orderkey::VARCHAR AS doc_id, '/Report[1]' AS data_location, '2' AS observed_value FROM {_DOCS} WHERE fine AND o_orderkey % 41 = 0")
def con_too_many(spark, sf_dir):
    """CON3."""
    return _out(conform.too_many_elements(_typed(spark, sf_dir, *_FOR_CHILDREN), st.declarations(spark)), "observed_value")


@query(f"SELECT o_orderkey::VARCHAR AS doc_id, '/Report[1]/Status[1]' AS data_location, 'Status after Date' AS observed_value FROM {_DOCS} WHERE fine AND o_orderkey % 37 = 0 AND o_orderkey % 17 <> 0")
def con_order(spark, sf_dir):
    """CON4."""
    return _out(conform.order_violations(_typed(spark, sf_dir, "seq", "parent_seq"), st.declarations(spark)), "observed_value")


@query(f"SELECT o_orderkey::VARCHAR AS doc_id, '/Report[1]' AS data_location, CASE WHEN o_orderkey % 59 = 0 THEN '0' ELSE '2' END AS observed_value FROM {_DOCS} WHERE fine AND (o_orderkey % 53 = 0 OR o_orderkey % 59 = 0)")
def con_choice(spark, sf_dir):
    """CON5."""
    return _out(conform.choice_violations(_typed(spark, sf_dir, *_FOR_CHILDREN), st.declarations(spark)), "observed_value")


@query(f"""SELECT l_orderkey::VARCHAR AS doc_id, '/Report[1]/Line[' || row_number() OVER (PARTITION BY l_orderkey) || ']' AS data_location, 'missing-attribute' AS error_code, 'Missing attribute n' AS message, '' AS observed_value FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 31 <> 0 AND l_orderkey % 43 = 0
  UNION ALL SELECT o_orderkey::VARCHAR, '/Report[1]', 'unknown-attribute', 'Unexpected attribute x', '1' FROM {_DOCS} WHERE fine AND o_orderkey % 47 = 0""")
def con_attributes(spark, sf_dir):
    """CON6: every finding with its place."""
    rows = shred.shredded(st.order_documents(spark, sf_dir), ("doc_id", "kind", "seq", "attrs"))
    return _out(conform.attribute_violations(_typed(spark, sf_dir, "seq"), shred.attributes(rows), st.declared_attributes(spark)), "error_code", "message", "observed_value")


@query(f"SELECT o_orderkey::VARCHAR AS doc_id, '/Report[1]/Date[' || i || ']' AS data_location, '2024-13-45' AS observed_value FROM {_DOCS}, (VALUES (1), (2)) v(i) WHERE fine AND o_orderkey % 29 = 0 AND (i = 1 OR o_orderkey % 41 = 0)")
def con_datatype(spark, sf_dir):
    """CON7."""
    return _out(conform.datatype_violations(_typed(spark, sf_dir, *_FOR_VALUES), kinds=_named(st.declarations(spark), "type_ref")), "observed_value")


@query(f"""SELECT o_orderkey::VARCHAR AS doc_id, '/Report[1]/Size[1]' AS data_location, (o_custkey % 100)::VARCHAR AS observed_value FROM {_DOCS} WHERE fine AND o_custkey % 100 > 89
  UNION ALL SELECT o_orderkey::VARCHAR, '/Report[1]/Form[1]', CASE WHEN o_orderkey % 61 = 0 THEN 'F2' ELSE 'F1' END FROM {_DOCS} WHERE fine
  UNION ALL SELECT k::VARCHAR, '/Report[1]/Line[' || i || ']/Part[1]', part::VARCHAR FROM (SELECT l_orderkey AS k, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey) AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE part > 89 AND k % 31 <> 0""")
def con_facets(spark, sf_dir):
    """CON8: every finding with its place and value."""
    return _out(conform.facet_violations(_typed(spark, sf_dir, *_FOR_VALUES), st.facets(spark), _named(st.facets(spark), "facet")), "observed_value")


@query(f"SELECT o_orderkey::VARCHAR AS doc_id, '/Report[1]/Status[1]' AS data_location, chr(10) || '    ' || o_orderstatus || chr(10) || '  ' AS observed_value FROM {_DOCS} WHERE fine AND o_orderkey % 23 = 0 AND o_orderkey % 17 <> 0")
def con_enumeration(spark, sf_dir):
    """CON9: padded values fail."""
    return _out(conform.enumeration_violations(_typed(spark, sf_dir, *_FOR_VALUES), st.status_values(spark)), "observed_value")


@query(f"SELECT o_orderkey::VARCHAR AS doc_id, '/Report[1]/Form[1]' AS data_location, 'F2' AS observed_value FROM {_DOCS} WHERE fine AND o_orderkey % 61 = 0")
def con_fixed(spark, sf_dir):
    """CON10."""
    return _out(conform.fixed_violations(_typed(spark, sf_dir, *_FOR_VALUES), st.declarations(spark)), "observed_value")


@query(f"SELECT o_orderkey::VARCHAR AS doc_id, 1::BIGINT AS n_repaired, 0::BIGINT AS n_left FROM {_DOCS} WHERE fine AND o_orderkey % 23 = 0 AND o_orderkey % 17 <> 0")
def con_repair(spark, sf_dir):
    """CON11: repaired values, and what still fails afterwards."""
    values = st.status_values(spark)
    # what is on no list is neither repaired nor left
    fixed, _ = stored(conform.repair_whitespace(_typed(spark, sf_dir, *_FOR_VALUES).join(values.select("type_ref").distinct(), "type_ref", "left_semi"), values))
    left = conform.enumeration_violations(fixed, values).groupBy("doc_id").agg(F.count("*").alias("n_left"))
    return fixed.where("repaired").groupBy("doc_id").agg(F.count("*").alias("n_repaired")).join(left, "doc_id", "left").withColumn("n_left", F.coalesce("n_left", F.lit(0)))


# ---- checks by schema files (SCH3, SCH4 -> CON1-10) ----------------------------------------------------------------


def _part_sets(spark, sf_dir):
    """The schema sets of all brands; the common file is no root."""
    rows = shred.shredded(st.part_schemas(spark, sf_dir)).persist()
    roots = rows.where("depth = 0 and doc_id like 'brand-%'").select(F.col("doc_id").alias("file"))
    return resolve.schema_sets(shred.elements(rows), shred.attributes(rows), shred.namespaces(rows), roots)


_CHILDREN = """list_filter([CASE WHEN k % 31 <> 0 THEN 'Id' END, CASE WHEN k % 2 = 0 THEN 'Made' END, CASE WHEN k % 17 = 0 THEN 'Size' WHEN k % 11 <> 0 THEN 'Kind' END, CASE WHEN k % 17 = 0 THEN 'Kind' ELSE 'Size' END, 'Retail', CASE WHEN k % 19 = 0 THEN 'Free' END]
  || CASE WHEN k % 3 = 0 THEN ['Tag', 'Mark', 'Tag'] ELSE [] END, lambda x: x IS NOT NULL)"""
_FOLLOWS = [("^", "Id"), ("Id", "Made"), ("Id", "Kind"), ("Made", "Kind"), ("Kind", "Size"), ("Size", "Retail"), ("Size", "Free"), *((a, b) for a in ("Retail", "Free", "Tag", "Mark") for b in ("Tag", "Mark", "$"))]


@query(f"""WITH p AS (SELECT p_partkey AS k, p_size, p_type FROM part), kids AS (SELECT k, ['^'] || {_CHILDREN} || ['$'] AS c FROM p),
  steps AS (SELECT k, i, c[i] AS a, c[i + 1] AS b, len(list_filter(c[1:i + 1], lambda x: x = c[i + 1])) AS n FROM (SELECT k, c, unnest(range(1, len(c))) AS i FROM kids)),
  found AS (SELECT k, 'unknown-element' AS error_code, '/Part[1]/Extra[1]' AS loc, 'Extra' AS v FROM p WHERE k % 13 = 0
    UNION ALL SELECT k, 'missing-element', '/Part[1]', '0' FROM p WHERE k % 31 = 0 UNION ALL SELECT k, 'missing-element', '/Part[1]', '0' FROM p WHERE k % 11 = 0 AND k % 17 <> 0
    UNION ALL SELECT k, 'content-model', CASE WHEN b = '$' THEN '/Part[1]' ELSE '/Part[1]/' || b || '[' || n || ']' END, b || ' after ' || CASE a WHEN '^' THEN 'the start' ELSE a END FROM steps WHERE (a, b) NOT IN ({', '.join(map(str, _FOLLOWS))})
    UNION ALL SELECT k, 'choice', '/Part[1]', '2' FROM p WHERE k % 19 = 0
    UNION ALL SELECT k, 'missing-attribute', '/Part[1]', '' FROM p WHERE k % 41 = 0 UNION ALL SELECT k, 'unknown-attribute', '/Part[1]', '1' FROM p WHERE k % 59 = 0
    UNION ALL SELECT k, 'datatype', '/Part[1]/Made[1]', '2024-13' FROM p WHERE k % 58 = 0 UNION ALL SELECT k, 'datatype', '/Part[1]/@k', 'x' || k FROM p WHERE k % 23 = 0 AND k % 41 <> 0 UNION ALL SELECT k, 'datatype', '/Part[1]/Retail[1]', 'cheap' FROM p WHERE k % 53 = 0
    UNION ALL SELECT k, 'facet', '/Part[1]/Size[1]', p_size::VARCHAR FROM p WHERE p_size > 40
    UNION ALL SELECT k, 'facet', '/Part[1]/Kind[1]', p_type FROM p WHERE k % 43 <> 0 AND length(p_type) > 24 AND (k % 17 = 0 OR k % 11 <> 0)
    UNION ALL SELECT k, 'enumeration', '/Part[1]/Kind[1]', 'NO SUCH KIND' FROM p WHERE k % 43 = 0 AND (k % 17 = 0 OR k % 11 <> 0) UNION ALL SELECT k, 'enumeration', '/Part[1]/@unit', 'st' FROM p WHERE k % 37 = 0
    UNION ALL SELECT k, 'fixed', '/Part[1]/Retail[1]/@cur', 'USD' FROM p WHERE k % 47 = 0)
  SELECT k::VARCHAR AS doc_id, error_code, loc AS data_location, v AS observed_value FROM found""")
def con_schema(spark, sf_dir):
    """SCH3, SCH4, CON1-10: schema files to declarations to findings, for documents of many schema sets at once: includes of a file
    without a namespace, an extended base type, groups, a repeating choice, a union, attribute values."""
    sets = _part_sets(spark, sf_dir)
    docs = st.part_documents(spark, sf_dir)
    rows = shred.shredded(docs).persist()
    typed = conform.typed_elements(shred.elements(rows).join(docs.select("doc_id", "set_id"), "doc_id"), sets.declarations).persist()
    return conform.check_against(typed, shred.attributes(rows), sets).select("doc_id", "error_code", "data_location", "observed_value")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AS moved FROM orders),
  found AS (SELECT k, 'unknown-element' AS error_code, '/Account[1]/Move[1]' AS loc, 'Move' AS v FROM o WHERE k % 7 <> 0 AND k % 5 = 0
    UNION ALL SELECT k, 'unknown-element', '/Account[1]/Fee[1]', 'Fee' FROM o WHERE k % 23 = 0
    UNION ALL SELECT k, 'choice', '/Account[1]', '0' FROM o WHERE NOT moved UNION ALL SELECT k, 'content-model', '/Account[1]/Code[1]', 'Code after the start' FROM o WHERE NOT moved
    UNION ALL SELECT k, 'datatype', '/Account[1]/' || CASE WHEN k % 3 = 0 THEN 'Reversal' ELSE 'Debit' END || '[1]', 'much' FROM o WHERE moved AND k % 11 = 0
    UNION ALL SELECT k, 'union', '/Account[1]/Code[1]', CASE WHEN k % 13 = 0 THEN 'C' ELSE '100' END FROM o WHERE k % 13 = 0 OR k % 17 = 0
    UNION ALL SELECT k, 'abstract-type', '/Account[1]/Holder[1]', 'Holder' FROM o WHERE k % 29 = 0)
  SELECT k::VARCHAR AS doc_id, error_code, loc AS data_location, v AS observed_value FROM found""")
def con_substitution(spark, sf_dir):
    """SCH3, CON1, CON5, CON7-9: elements that stand for abstract ones, over two steps of a substitution group, with the type of the
    nearest head; abstract types; a union of a list of values and a bounded number."""
    rows = shred.shredded(st.ledger_schemas(spark, sf_dir)).persist()
    roots = rows.where("depth = 0 and doc_id like 'ledger-%'").select(F.col("doc_id").alias("file"))
    sets = resolve.schema_sets(shred.elements(rows), shred.attributes(rows), shred.namespaces(rows), roots)
    docs = st.ledger_documents(spark, sf_dir)
    rows = shred.shredded(docs).persist()
    typed = conform.typed_elements(shred.elements(rows).join(docs.select("doc_id", "set_id"), "doc_id"), sets.declarations).persist()
    return conform.check_against(typed, shred.attributes(rows), sets).select("doc_id", "error_code", "data_location", "observed_value")


_OF_PART = """(VALUES ('ThingType', 'Id', 'int', 1, 1, 1), ('ThingType', 'Made', 'WhenType', 2, 0, 1), ('PartType', 'Id', 'int', 1, 1, 1), ('PartType', 'Made', 'WhenType', 2, 0, 1), ('PartType', 'Kind', 'KindType', 3, 1, 1),
  ('PartType', 'Size', 'SizeType', 4, 1, 1), ('PartType', 'Retail', 'AmountType', 5, 1, 1), ('PartType', 'Free', '', 5, 1, 1), ('PartType', 'Tag', 'ShortText', 6, 0, NULL), ('PartType', 'Mark', 'string', 6, 0, NULL),
  ('#root', 'Part', 'PartType', 1, 0, 1), ('#root', 'Tag', 'ShortText', 1, 0, 1)) t(owner, name, type_ref, pos, min_occurs, max_occurs)"""


@query(f"SELECT 'brand-' || b || '.xsd' AS set_id, owner, name, type_ref, pos::INTEGER AS pos, min_occurs::INTEGER AS min_occurs, max_occurs::INTEGER AS max_occurs, name IN ('Retail', 'Free') AS in_choice FROM (SELECT DISTINCT {_B} AS b FROM part), {_OF_PART}")
def sch_declarations(spark, sf_dir):
    """SCH3: the declarations of every brand's schema set, base content first."""
    d = _part_sets(spark, sf_dir).declarations
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"\A.*\}", ""), "#common/.*", "")
    return d.select("set_id", bare(F.col("owner")).alias("owner"), "name", bare(F.col("type_ref")).alias("type_ref"), "pos", "min_occurs", "max_occurs", F.col("choice_id").isNotNull().alias("in_choice"))


@query(f"""SELECT o_orderkey::VARCHAR AS doc_id, '/Report[1]' AS data_location, 1 AS line, 1 AS col FROM {_DOCS} WHERE fine AND o_orderkey % 17 = 0
  UNION ALL SELECT o_orderkey::VARCHAR, '/Report[1]/Status[1]', 3 + CASE WHEN o_orderkey % 37 = 0 THEN {_DATES} ELSE 0 END, 3 FROM {_DOCS} WHERE fine AND o_orderkey % 23 = 0 AND o_orderkey % 17 <> 0
  UNION ALL SELECT o_orderkey::VARCHAR, '/Report[1]/Nowhere[1]', 1, 1 FROM {_DOCS} WHERE fine AND o_orderkey % 61 = 0""")
def con_locate(spark, sf_dir):
    """CON12: exact places, and the nearest ancestor's where the path doesn't exist."""
    typed, _ = stored(_typed(spark, sf_dir, *_FOR_VALUES, *_FOR_CHILDREN))
    found = conform.missing_elements(typed, st.declarations(spark)).unionByName(conform.enumeration_violations(typed, st.status_values(spark)))
    ghost = conform.fixed_violations(typed, st.declarations(spark)).withColumn("data_location", F.lit("/x:Report/Nowhere"))
    out = _with_place(found.unionByName(ghost), st.order_documents(spark, sf_dir))
    return out.select("doc_id", S.normalize_path(F.col("data_location")).alias("data_location"), "line", "col")


# ---- findings and runs (FND) ---------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey::VARCHAR AS doc_id, fine AS well_formed, fine AND o_orderkey % 29 <> 0 AS schema_valid, CASE WHEN fine AND o_orderkey % 29 <> 0 THEN 'passed' ELSE 'failed' END AS status, (CASE WHEN NOT fine THEN 1 WHEN o_orderkey % 29 = 0 THEN {_DATES} ELSE 0 END)::BIGINT AS finding_count FROM {_DOCS}")
def fnd_reports(spark, sf_dir):
    """FND1: parse errors and bad dates; passed documents have reports too."""
    docs = st.order_documents(spark, sf_dir)
    found = _with_place(conform.datatype_violations(_typed(spark, sf_dir, *_FOR_VALUES), kinds=_named(st.declarations(spark), "type_ref")), docs).unionByName(shred.parse_findings(shred.unparsed(docs)))
    return findings.schema_reports(docs, found).select("doc_id", "well_formed", "schema_valid", "status", "finding_count")


_RUN = "user_id || '-' || strftime(ts, '%Y%m%d')"


@query(f"SELECT {_RUN} AS run_id, count(*) FILTER (event_type = 'view') AS info, count(*) FILTER (event_type = 'click') AS warning, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'signup') AS critical FROM events WHERE event_type <> 'purchase' GROUP BY 1")
def fnd_summary(spark, sf_dir):
    """FND2."""
    return findings.severity_summary(st.event_findings(spark, sf_dir))


@query("SELECT s_suppkey::VARCHAR AS doc_id, CASE WHEN s_suppkey % 3 = 0 THEN 'first' ELSE 'both' END AS investor_scope, list_transform(['0', '1', '2', '3', '4'], lambda x: 'v' || x) AS rule_set_versions, (s_suppkey % 4 = 0)::BIGINT AS error FROM supplier")
def fnd_runs(spark, sf_dir):
    """FND3: suppliers as packages, nations as rules."""
    sup = st.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.when(F.col("s_suppkey") % 4 == 0, "no xml").otherwise("<a/>").alias("xml"), F.when(F.col("s_suppkey") % 3 == 0, "first").alias("scope"))
    packs = src.packages_from_table(sup, "doc_id", "xml", scope_col="scope")
    rules = st.table(spark, sf_dir, "nation").select(F.concat(F.lit("v"), F.col("n_regionkey").cast("string")).alias("source_version"))
    return findings.validation_runs(packs, shred.unreadable_packages(packs), rules).select("doc_id", "investor_scope", "rule_set_versions", "error")


@query("SELECT s_suppkey::VARCHAR AS rule_id FROM supplier WHERE s_suppkey % 3 <> 1")
def fnd_scope(spark, sf_dir):
    """FND4: rules of the first investor and the shared ones."""
    rules = st.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("rule_id"), F.element_at(F.array(F.lit("first"), F.lit("second"), F.lit("both")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("applies_to"))
    return findings.rules_in_scope(rules, "first").select("rule_id")


@query("SELECT user_id::VARCHAR AS doc_id, count(*) FILTER (user_id % 3 = 0) AS first_only, count(*) FILTER (user_id % 3 = 1) AS second_only, count(*) FILTER (user_id % 3 = 2) AS shared FROM events WHERE event_type <> 'purchase' GROUP BY 1")
def fnd_split(spark, sf_dir):
    """FND5."""
    return findings.split_by_investor(st.event_findings(spark, sf_dir))


@query("""SELECT event_id::VARCHAR AS finding_id, CASE WHEN event_type = 'purchase' THEN 'No stored finding was found for ' || event_id || '. Explanation is unavailable.'
  ELSE 'Finding ' || event_id || ' is based on ' || CASE WHEN event_id % 2 = 0 THEN 'the governing rule' ELSE 'section ' || user_id END || '. Observed value: ' || CASE WHEN event_id % 3 = 0 THEN 'not applicable' ELSE event_type END || '. Expected condition: see source rule.' END AS explanation FROM events""")
def fnd_explain(spark, sf_dir):
    """FND6."""
    e = st.table(spark, sf_dir, "events").withColumn("finding_id", F.col("event_id").cast("string"))
    found = e.where("event_type <> 'purchase'").select(
        "finding_id", F.when(F.col("event_id") % 2 != 0, F.concat(F.lit("section "), F.col("user_id").cast("string"))).alias("source_section"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("observed_value"), F.lit(None).cast("string").alias("expected_condition"),
    )
    return findings.explain_findings(e.select("finding_id"), found)


@query(f"""SELECT conv_id, turn, CASE WHEN text IS NULL OR regexp_full_match(text, '\\s*') THEN '{findings.BLANK_REVIEW}' WHEN turn % 2 = 0 AND NOT contains(text, 'the') THEN '{findings.NO_REFERENCE}' ELSE '{findings.ALL_CLEAR}' END AS first_comment FROM conversations""")
def fnd_review(spark, sf_dir):
    """FND7."""
    c = st.table(spark, sf_dir, "conversations").withColumn("related_finding_ids", F.when(F.col("turn") % 2 == 0, F.array(F.lit("the"), F.lit("F-none"))).otherwise(F.array().cast("array<string>")))
    return findings.review_texts(c).select("conv_id", "turn", F.get("comments", F.lit(0)).alias("first_comment"))


@query(f"SELECT count(*) AS n, count(*) AS n_ids FROM events WHERE event_type <> 'purchase'")
def fnd_ids(spark, sf_dir):
    """FND8: ids are distinct, also of findings that say the same."""
    f = st.event_findings(spark, sf_dir).select("run_id", F.col("signature").alias("message"), F.lit("/").alias("data_location"), F.col("severity").alias("error_code"))
    return findings.finding_ids(f).agg(F.count("*").alias("n"), F.count_distinct("finding_id").alias("n_ids"))


# ---- registry (REG) ------------------------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def reg_upsert(spark, sf_dir):
    """REG1: last event of each user."""
    return registry.upsert_latest(st.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("SELECT c_custkey AS key, c_name AS name, true AS found FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT -o_custkey - 1, NULL, false FROM orders WHERE o_orderstatus = 'P'")
def reg_lookup(spark, sf_dir):
    """REG2: known and unknown ids."""
    c = st.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    o = st.table(spark, sf_dir, "orders")
    keys = o.select(F.col("o_custkey").alias("key")).unionByName(o.where("o_orderstatus = 'P'").select((-F.col("o_custkey") - 1).alias("key")))
    return registry.lookup(c, keys, "key")


@query("SELECT p_type AS name, 'schema_element:' || min(p_partkey) AS resource_id FROM part GROUP BY p_type UNION ALL SELECT 'NOTHING', NULL")
def reg_find(spark, sf_dir):
    """REG3: first resource per label."""
    p = st.table(spark, sf_dir, "part").select(F.lit("schema_element").alias("resource_type"), F.col("p_type").alias("label"), F.concat(F.lit("schema_element:"), F.col("p_partkey").cast("string")).alias("resource_id"), F.col("p_name").alias("iri"), F.col("p_partkey").alias("insert_order"))
    names = p.select(F.col("label").alias("name")).distinct().unionByName(p.agg(F.lit("NOTHING").alias("name")))
    return registry.find_schema_elements(p, names).select("name", "resource_id")


def _origin():
    return registry.provenance(F.lit("schema"), F.lit("v1"), F.lit("s"), F.to_timestamp(F.lit("2024-01-01 00:00:00")))


@query("SELECT 'part:' || p_name AS resource_id, 'https://example.org/reports/part/' || replace(p_name, ' ', '_') AS iri, 'v1' AS source_version, count(*) AS n FROM part GROUP BY p_name")
def reg_resources(spark, sf_dir):
    """REG4."""
    rows = st.table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_name").alias("name"))
    out = registry.ingest_resources(rows, _origin())
    return out.groupBy("resource_id", "iri", F.col("provenance.source_version").alias("source_version")).agg(F.count("*").alias("n"))


@query("SELECT 'R' || s_suppkey AS rule_id, 'schema' AS source, CASE WHEN s_suppkey % 2 = 0 THEN 'first' ELSE 'both' END AS investor, 'active' AS status FROM supplier")
def reg_rules(spark, sf_dir):
    """REG5: defaults and catalogue."""
    rows = st.table(spark, sf_dir, "supplier").select(F.concat(F.lit("R"), F.col("s_suppkey").cast("string")).alias("rule_id"), F.when(F.col("s_suppkey") % 2 == 0, "first").alias("applies_to"))
    return registry.rule_catalogue(registry.ingest_rules(rows, _origin()))


# ---- strings (STR) -------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g') AS a, '_' || p_size || '_x' AS b, regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g') AS c, p_type AS d, p_name AS e, p_type || ' ' || p_size AS f,
  false AS g, true AS h, 'https://example.org/reports/ontology#' || p_type AS i FROM part""")
def str_names(spark, sf_dir):
    """STR1-7."""
    p = st.table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    return p.select(
        "p_partkey", S.local_name_from_text(F.concat(F.lit(" \n"), "p_brand", F.lit("\t "))).alias("a"), S.local_name_from_text(F.concat(size, F.lit(" x"))).alias("b"),
        S.local_name_from_arcrole(F.concat(F.lit("urn:a/b:"), F.regexp_replace("p_brand", "#", " "), F.lit("/#/"))).alias("c"), S.strip_type_suffix(F.concat("p_type", F.lit("Type"))).alias("d"),
        S.strip_prefix(F.concat(F.lit("x:"), "p_name")).alias("e"), S.label_from_local_name(F.concat("p_type", F.lit("_"), size)).alias("f"),
        S.is_valid_local_name(F.concat("p_type", F.lit("\n"))).alias("g"), S.is_valid_local_name(F.col("p_type")).alias("h"), S.mint_term_iri(F.col("p_type")).alias("i"),
    )


@query("SELECT p_partkey, 'https://example.org/reports/part/' || replace(p_name, ' ', '_') || '/' || p_brand || '/a%2Ab~c%2Bd' AS iri, p_type || '#' AS ns, p_type || '/' AS ns2 FROM part")
def str_iris(spark, sf_dir):
    """STR8-9."""
    p = st.table(spark, sf_dir, "part")
    return p.select("p_partkey", S.mint_path_iri(F.lit("part"), F.col("p_name"), F.lit("  "), F.col("p_brand"), F.lit("a*b~c+d")).alias("iri"), S.with_fragment_separator(F.col("p_type")).alias("ns"), S.with_fragment_separator(F.concat("p_type", F.lit("/"))).alias("ns2"))


@query("SELECT user_id, string_agg(event_type, chr(10) || chr(10) ORDER BY event_id) FILTER (event_type <> 'view') AS doc FROM events GROUP BY user_id")
def str_documentation(spark, sf_dir):
    """STR10: events as documentation texts in order; views are blank."""
    e = st.table(spark, sf_dir, "events").withColumn("t", F.when(F.col("event_type") == "view", "  ").otherwise(F.concat(F.lit("\n "), "event_type", F.lit(" "))))
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "t"))).alias("x")).select("user_id", S.documentation_text(F.col("x.t")).alias("doc"))


# ---- schemas and vocabularies (SCH, VOC) ---------------------------------------------------------------------------



def _schema_rows(spark, sf_dir):
    rows = shred.shredded(st.schema_documents(spark, sf_dir)).persist()
    return shred.elements(rows), shred.attributes(rows)


@query(f"""SELECT DISTINCT 'brand-' || {_B} || '.xsd' AS file, {_B}::INTEGER % 4 <> 0 AND {_B}::INTEGER % 4 <> 1 AS ok, CASE {_B}::INTEGER % 4 WHEN 0 THEN 'xml-declaration' WHEN 1 THEN 'prefix-mismatch' END AS error_code,
  CASE WHEN {_B}::INTEGER % 4 > 1 THEN 4 END AS line_number, CASE WHEN {_B}::INTEGER % 4 > 1 THEN 3 END AS n_attributes FROM part""")
def sch_headers(spark, sf_dir):
    """SRC2's table, SCH1: half of the headers are broken."""
    f = st.schema_documents(spark, sf_dir)
    b = F.regexp_extract("file", r"(\d+)", 1).cast("int") % 4
    text = F.when(b == 0, F.replace(F.col("text"), F.lit("UTF-8"), F.lit("utf-8"))).when(b == 1, F.replace(F.col("text"), F.lit("<xsd:schema"), F.lit("<xs:schema"))).otherwise(F.col("text"))
    return schema.schema_headers(f.withColumn("text", text)).select("file", "ok", "error_code", "line_number", F.when(F.col("ok"), F.size("attributes")).alias("n_attributes"))


_CONSTRUCTS = "['annotation', 'complexContent', 'complexType', 'documentation', 'element', 'enumeration', 'extension', 'restriction', 'sequence', 'simpleType']"


@query(f"SELECT 'brand-' || {_B} || '.xsd' AS file, array_to_string(CASE WHEN max(p_size) > 40 THEN {_CONSTRUCTS} ELSE ['annotation', 'documentation', 'enumeration', 'restriction', 'simpleType'] END, ',') AS constructs FROM part GROUP BY 1")
def sch_profile(spark, sf_dir):
    """SCH2."""
    return schema.component_profile(_schema_rows(spark, sf_dir)[0]).select("file", F.array_join("constructs", ",").alias("constructs"))


@query(f"""SELECT 'brand-' || b || '.xsd' AS file, array_to_string(['File: brand-' || b || '.xsd', 'Header line: 4', 'Prefix: xsd', 'Attributes:', '  xmlns:xsd="{XSD.rstrip('#')}"', '  targetNamespace="urn:brand:' || b || '"', '  xmlns:b="urn:brand:' || b || '"', 'Constructs:',
  '  ' || array_to_string(CASE WHEN big THEN {_CONSTRUCTS} ELSE ['annotation', 'documentation', 'enumeration', 'restriction', 'simpleType'] END, chr(10) || '  ')], chr(10)) AS value FROM (SELECT {_B} AS b, max(p_size) > 40 AS big FROM part GROUP BY 1)""")
def snk_profiles(spark, sf_dir):
    """SNK3: the whole text of each file's profile."""
    heads = schema.schema_headers(st.schema_documents(spark, sf_dir))
    return src.profile_texts(heads.join(schema.component_profile(_schema_rows(spark, sf_dir)[0]), "file"))


@query(f"""SELECT file, construct, count(*) AS n, min(o) AS owner FROM (
  SELECT DISTINCT {_B} AS file, 'enumeration' AS construct, p_type AS x, 'Part_KindType' AS o FROM part UNION ALL SELECT DISTINCT {_B}, 'complexType', p_size::VARCHAR, NULL FROM part WHERE p_size > 40
  UNION ALL SELECT DISTINCT {_B}, 'extension', p_size::VARCHAR, 'Size' || p_size || 'Type' FROM part WHERE p_size > 40) GROUP BY ALL""".replace("SELECT file, construct, count(*) AS n, min(o) AS owner FROM", "SELECT 'brand-' || file || '.xsd' AS file, construct, count(*) AS n, min(o) AS owner FROM").replace("GROUP BY ALL", "GROUP BY file, construct"))
def sch_components(spark, sf_dir):
    """SCH3."""
    c = schema.schema_components(*_schema_rows(spark, sf_dir))
    c = c.where("construct in ('enumeration', 'complexType', 'extension') and coalesce(name, '') not like 'urn:%'")
    return c.groupBy("file", "construct").agg(F.count("*").alias("n"), F.min("owner").alias("owner"))


@query("SELECT 'file-' || n_nationkey AS file, n_nationkey::INTEGER AS depth, n_nationkey < 24 AS present FROM nation UNION ALL SELECT 'file-x', 1, false")
def sch_includes(spark, sf_dir):
    """SCH4: a chain of includes with a cycle and a missing target."""
    n = st.table(spark, sf_dir, "nation")
    name = lambda c: F.concat(F.lit("file-"), c.cast("string"))
    chain = n.where("n_nationkey < 24").select(name(F.col("n_nationkey")).alias("file"), name(F.col("n_nationkey") + 1).alias("target"))
    more = n.where("n_nationkey = 0").select(F.lit("file-0").alias("file"), F.lit("file-x").alias("target")).unionByName(n.where("n_nationkey = 5").select(F.lit("file-5").alias("file"), F.lit("file-2").alias("target")))
    return schema.resolve_schema_files(chain.unionByName(more), "file-0")


@query("SELECT CASE WHEN s = 1 THEN 'first' ELSE 'second' END AS side, p_type AS name, n FROM (SELECT p_type, 1 AS s, count(*) FILTER (p_size % 2 = 0) - count(*) FILTER (p_size % 3 = 0) AS n FROM part GROUP BY 1 UNION ALL SELECT p_type, 2, count(*) FILTER (p_size % 3 = 0) - count(*) FILTER (p_size % 2 = 0) FROM part GROUP BY 1) WHERE n > 0")
def sch_compare(spark, sf_dir):
    """SCH5."""
    p = st.table(spark, sf_dir, "part").select(F.lit("element").alias("construct"), F.lit(None).cast("string").alias("owner"), F.col("p_type").alias("name"), "p_size")
    return schema.compare_schemas(p.where("p_size % 2 = 0"), p.where("p_size % 3 = 0")).select("side", "name", "n")


@query("SELECT event_type AS construct, CASE event_type WHEN 'view' THEN 'class' WHEN 'click' THEN 'property' END AS becomes, event_type NOT IN ('view', 'click') AS unmapped, count(*) AS n FROM events GROUP BY ALL")
def sch_translation(spark, sf_dir):
    """SCH6: event types as constructs."""
    rules = spark.createDataFrame([("view", "class", False, False), ("click", "property", True, False)], "construct string, becomes string, needs_context boolean, ordered boolean")
    c = st.table(spark, sf_dir, "events").select(F.col("event_type").alias("construct"))
    return schema.apply_translation_profile(c, rules).groupBy("construct", "becomes", "unmapped").agg(F.count("*").alias("n"))


@query(f"""WITH v AS (SELECT DISTINCT {_B} AS b, p_type AS v FROM part) SELECT 'brand-' || b || '.xsd' AS graph_id, 'Part_Kind-' || regexp_replace(v, '[^A-Za-z0-9_]', '_', 'g') AS s, p, CASE p WHEN 'type' THEN 'Concept' WHEN 'inScheme' THEN 'Part_Kind' WHEN 'comment' THEN 'about ' || v ELSE v END AS o
  FROM v, (VALUES ('type'), ('inScheme'), ('prefLabel'), ('sourceEnumerationValue'), ('comment')) t(p)
  UNION ALL SELECT DISTINCT 'brand-' || b || '.xsd', 'Part_Kind', p, CASE p WHEN 'type' THEN 'ConceptScheme' WHEN 'sourceSimpleTypeName' THEN 'Part_KindType' ELSE 'Part_Kind' END FROM v, (VALUES ('type'), ('label'), ('prefLabel'), ('sourceSimpleTypeName')) t(p)""")
def voc_enumerations(spark, sf_dir):
    """VOC1-2."""
    rows = vocab.enumerations(*_schema_rows(spark, sf_dir)).withColumn("graph_id", F.col("doc_id")).where("type_name <> 'ArcroleBase'")
    return vocab.enumeration_triples(rows).select("graph_id", _short(F.col("s")).alias("s"), _short(F.col("p")).alias("p"), _short(F.col("o")).alias("o"))


@query(f"""WITH v AS (SELECT DISTINCT {_B} AS b, 'Size' || p_size AS v FROM part WHERE p_size > 40) SELECT 'brand-' || b || '.xsd' AS graph_id, v AS s, p, CASE p WHEN 'subClassOf' THEN 'Base' WHEN 'sourceBaseTypeName' THEN 'BaseType' WHEN 'label' THEN v ELSE v || 'Type' END AS o
  FROM v, (VALUES ('subClassOf'), ('sourceBaseTypeName'), ('label'), ('sourceComplexTypeName')) t(p) UNION ALL SELECT 'brand-' || b || '.xsd', v, 'type', o FROM v, (VALUES ('Class'), ('SchemaComponent')) t(o)""")
def voc_complex_types(spark, sf_dir):
    """VOC3-4."""
    rows = vocab.complex_types(*_schema_rows(spark, sf_dir)).withColumn("graph_id", F.col("doc_id"))
    return vocab.complex_type_triples(rows).select("graph_id", _short(F.col("s")).alias("s"), _short(F.col("p")).alias("p"), _short(F.col("o")).alias("o"))


@query(f"""WITH v AS (SELECT DISTINCT {_B} AS b FROM part) SELECT 'brand-' || b || '.xsd' AS graph_id, p, CASE p WHEN 'label' THEN 'PART IsMadeBy BRAND' ELSE 'urn:x:brand' || b || '/PART_IsMadeBy_BRAND' END AS o FROM v, (VALUES ('label'), ('sourceArcroleUri')) t(p)
  UNION ALL SELECT 'brand-' || b || '.xsd', 'type', o FROM v, (VALUES ('ObjectProperty'), ('RelationshipPredicate')) t(o)""")
def voc_arcroles(spark, sf_dir):
    """VOC5-6."""
    rows = vocab.arcroles(*_schema_rows(spark, sf_dir)).withColumn("graph_id", F.col("doc_id"))
    return vocab.arcrole_triples(rows).select("graph_id", _short(F.col("p")).alias("p"), _short(F.col("o")).alias("o"))


@query(f"""WITH v AS (SELECT DISTINCT {_B} AS b, p_size AS z FROM part WHERE p_size > 40) SELECT 'brand-' || b || '.xsd' AS graph_id, 'urn:brand:' || b || '#Size' || z || 'Type' AS s, 'type' AS p, 'Class' AS o FROM v
  UNION ALL SELECT 'brand-' || b || '.xsd', 'urn:brand:' || b || '#Box' || z, 'type', 'ObjectProperty' FROM v UNION ALL SELECT 'brand-' || b || '.xsd', 'urn:brand:' || b || '#Box' || z, 'range', 'Size' || z || 'Type' FROM v""")
def voc_schema(spark, sf_dir):
    """VOC7."""
    return vocab.schema_triples(*_schema_rows(spark, sf_dir)).select("graph_id", "s", _short(F.col("p")).alias("p"), _short(F.col("o")).alias("o"))


def _components(spark, sf_dir):
    return schema.schema_components(*_schema_rows(spark, sf_dir))


@query(f"SELECT 'brand-' || b || '.xsd' AS file, kind, count(*) AS n FROM (SELECT DISTINCT {_B} AS b, 'Box' || p_size AS x, 'ObjectProperty' AS kind FROM part WHERE p_size > 40 UNION SELECT DISTINCT {_B}, 'Width', 'DatatypeProperty' FROM part WHERE p_size > 40) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY b, kind"))
def voc_refine(spark, sf_dir):
    """VOC8."""
    return vocab.refine_properties(_components(spark, sf_dir)).groupBy("file", "kind").agg(F.count("*").alias("n"))


@query(f"SELECT 'shape:Size' || p_size || 'Type' AS shape, 'Width' AS path, kind, CASE kind WHEN 'maxCount' THEN '1' ELSE '{XSD}int' END AS value FROM (SELECT DISTINCT p_size FROM part WHERE p_size > 40), (VALUES ('maxCount'), ('datatype')) t(kind)")
def voc_shapes(spark, sf_dir):
    """VOC9."""
    return vocab.structural_shapes(_components(spark, sf_dir)).select("shape", _short(F.col("path")).alias("path"), "kind", "value").distinct()


@query(f"""SELECT 'brand-' || b || '.xsd' AS set_id, name, kind, range FROM (SELECT DISTINCT {_B} AS b FROM part), (VALUES ('Part', 'ObjectProperty', 'PartType'), ('Free', 'ObjectProperty', NULL), ('Id', 'DatatypeProperty', '{XSD}int'),
  ('Made', 'DatatypeProperty', 'WhenType'), ('Kind', 'DatatypeProperty', 'KindType'), ('Size', 'DatatypeProperty', 'SizeType'), ('Retail', 'DatatypeProperty', 'AmountType'), ('Tag', 'DatatypeProperty', 'ShortText'), ('Mark', 'DatatypeProperty', '{XSD}string'),
  ('k', 'DatatypeProperty', '{XSD}int'), ('cur', 'DatatypeProperty', '{XSD}string'), ('unit', 'DatatypeProperty', 'UnitType'), ('lot', 'DatatypeProperty', 'ShortText')) t(name, kind, range)""")
def voc_set_properties(spark, sf_dir):
    """VOC8 over includes: types that the root file doesn't declare itself."""
    return vocab.set_properties(_part_sets(spark, sf_dir))


_SHAPES = """('ThingType', 'Id', 'minCount', '1', '', ''), ('ThingType', 'Id', 'maxCount', '1', '', ''), ('ThingType', 'Id', 'datatype', 'int', '', ''), ('ThingType', 'Made', 'maxCount', '1', '', ''), ('ThingType', 'Made', 'datatype', 'gYear', 'Made type', 'gYear'),
  ('ThingType', 'Made', 'datatype', 'gYearMonth', 'Made type', 'gYearMonth'), ('ThingType', 'Made', 'datatype', 'date', 'Made type', 'date'), ('ThingType', 'k', 'minCount', '1', '', ''), ('ThingType', 'k', 'maxCount', '1', '', ''), ('ThingType', 'k', 'datatype', 'int', '', '')"""
_PART_SHAPES = """('Kind', 'minCount', '1'), ('Kind', 'maxCount', '1'), ('Kind', 'datatype', 'string'), ('Kind', 'maxLength', '24'), ('Size', 'minCount', '1'), ('Size', 'maxCount', '1'), ('Size', 'datatype', 'int'), ('Size', 'minInclusive', '1'), ('Size', 'maxInclusive', '40'),
  ('Retail', 'minCount', '1'), ('Retail', 'maxCount', '1'), ('Retail', 'datatype', 'decimal'), ('Free', 'minCount', '1'), ('Free', 'maxCount', '1'), ('Free', 'node', 'shape:#'), ('Tag', 'datatype', 'string'), ('Tag', 'maxLength', '24'), ('Mark', 'datatype', 'string'),
  ('unit', 'maxCount', '1'), ('unit', 'datatype', 'string'), ('unit', 'in', 'kg'), ('unit', 'in', 'lb'), ('lot', 'maxCount', '1'), ('lot', 'datatype', 'string'), ('lot', 'maxLength', '24')"""


@query(f"""WITH own AS (SELECT * FROM (VALUES {_SHAPES}) t(owner, path, kind, value, g, branch)),
  every AS (SELECT * FROM own UNION ALL SELECT 'PartType', path, kind, value, g, branch FROM own UNION ALL SELECT 'AmountType', 'cur', kind, value, '', '' FROM (VALUES ('maxCount', '1'), ('datatype', 'string'), ('in', 'EUR')) t(kind, value)
    UNION ALL SELECT 'PartType', path, kind, value, CASE WHEN path IN ('Retail', 'Free') AND kind = 'minCount' THEN 'choice' ELSE '' END, CASE WHEN path IN ('Retail', 'Free') AND kind = 'minCount' THEN path ELSE '' END FROM (VALUES {_PART_SHAPES}) t(path, kind, value))
  SELECT 'brand-' || b || '.xsd' AS set_id, owner, path, kind, value, g, branch FROM (SELECT DISTINCT {_B} AS b FROM part), every
  UNION ALL SELECT DISTINCT 'brand-' || {_B} || '.xsd', 'PartType', 'Kind', 'in', p_type, '', '' FROM part""")
def voc_set_shapes(spark, sf_dir):
    """VOC9 over includes: inherited content, attributes, facets of base types, node, alternatives of a choice and of a union."""
    rows = vocab.set_shapes(_part_sets(spark, sf_dir))
    choice = F.col("group_id").contains("/")
    return rows.select(
        "set_id", F.substring_index("target_class", "#", -1).alias("owner"), _short(F.col("path")).alias("path"), "kind",
        F.when(F.col("kind") == "datatype", _short(F.col("value"))).when(F.col("kind") == "node", F.regexp_replace("value", "#.*", "#")).otherwise(F.col("value")).alias("value"),
        F.when(choice, "choice").otherwise(F.coalesce("group_id", F.lit(""))).alias("g"), F.when(choice, _short(F.col("path"))).otherwise(F.coalesce("branch", F.lit(""))).alias("branch"),
    )


# ---- projection and links (PRJ, LNK) -------------------------------------------------------------------------------


@query("""WITH d AS (SELECT o_orderkey AS k, o_orderkey || '/o' || o_orderkey AS root, * FROM orders WHERE o_orderkey % 31 <> 0),
  l AS (SELECT k, root, l_linenumber AS n, l_returnflag AS f, l_partkey AS part, k || '/' || substr(sha256('/Report[1]/Line[' || row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_returnflag, l_partkey) || ']'), 1, 20) AS node FROM lineitem JOIN d ON k = l_orderkey)
  SELECT k::VARCHAR AS graph_id, root AS s, 'type' AS p, 'ReportType' AS o, 'iri' AS o_kind, NULL AS o_datatype FROM d
  UNION ALL SELECT k::VARCHAR, root, 'Form', CASE WHEN k % 61 = 0 THEN 'F2' ELSE 'F1' END, 'literal', 'string' FROM d
  UNION ALL SELECT k::VARCHAR, root, 'Status', CASE WHEN k % 23 = 0 THEN chr(10) || '    ' || o_orderstatus || chr(10) || '  ' ELSE o_orderstatus END, 'literal', 'string' FROM d WHERE k % 17 <> 0
  UNION ALL SELECT k::VARCHAR, root, 'Date', CASE WHEN k % 29 = 0 THEN '2024-13-45' ELSE strftime(o_orderdate, '%Y-%m-%d') END, 'literal', 'string' FROM d
  UNION ALL SELECT k::VARCHAR, root, 'Cash', '1', 'literal', 'int' FROM d WHERE k % 59 <> 0 AND (k % 53 = 0 OR o_orderpriority = '1-URGENT')
  UNION ALL SELECT k::VARCHAR, root, 'Loan', '1', 'literal', 'int' FROM d WHERE k % 59 <> 0 AND (k % 53 = 0 OR o_orderpriority <> '1-URGENT')
  UNION ALL SELECT k::VARCHAR, root, 'Size', (o_custkey % 100)::VARCHAR, 'literal', 'int' FROM d
  UNION ALL SELECT k::VARCHAR, root, 'x', '1', 'literal', 'string' FROM d WHERE k % 47 = 0
  UNION ALL SELECT k::VARCHAR, root, 'Line', node, 'iri', NULL FROM l UNION ALL SELECT k::VARCHAR, node, 'type', 'LineType', 'iri', NULL FROM l
  UNION ALL SELECT k::VARCHAR, node, 'Flag', f, 'literal', 'string' FROM l UNION ALL SELECT k::VARCHAR, node, 'Part', part::VARCHAR, 'literal', 'int' FROM l
  UNION ALL SELECT k::VARCHAR, node, 'n', n::VARCHAR, 'literal', 'string' FROM l WHERE k % 43 <> 0""")
def prj_instances(spark, sf_dir):
    """PRJ1-2: every triple of every report, node names included; equal repeats are one fact."""
    docs = st.order_documents(spark, sf_dir)
    typed = lambda of: _typed_of(of, "parent_path", "attrs", "own_id", "up_id", "again", "alike", *_FOR_VALUES)
    if st.table(spark, sf_dir, "orders").groupBy("o_orderkey").count().where("count > 1").limit(1).count():
        out = project.project_instances(typed(docs))
    else:
        # only documents that may say something twice are shuffled
        out = project.project_instances(typed(docs).where("not alike"), once=True).unionByName(project.project_instances(typed(shred.alike(docs))))
    name = lambda c: F.regexp_replace(c, "^.*/instance/", "")
    value = F.when(F.col("o_kind") == "iri", _short(name("o"))).otherwise(F.col("o"))
    return out.select("graph_id", name("s").alias("s"), _short(F.col("p")).alias("p"), value.alias("o"), "o_kind", _short(F.col("o_datatype")).alias("o_datatype"))


@query(f"SELECT o_orderkey::VARCHAR AS doc_id FROM {_DOCS} WHERE fine AND o_orderkey % 19 <> 0")
def prj_unprojectable(spark, sf_dir):
    """PRJ3: documents without unsupported constructs."""
    return project.unprojectable(_typed(spark, sf_dir))[1]


def _links(spark, sf_dir):
    """Order -> line arcs; every seventh order's arcs point nowhere, every eleventh uses an unknown arcrole."""
    li = st.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).distinct()
    doc, seq = F.col("k").cast("string").alias("doc_id"), F.col("n").alias("seq")
    arcs = li.select(doc, (F.col("n") + 100).alias("seq"), F.when(F.col("k") % 11 == 0, "urn:r/ORDER_IsMade").otherwise(F.when(F.col("k") % 5 == 0, "urn:r/ORDER_HasPart_LINE").otherwise("urn:r/ORDER_Contains_LINE")).alias("arcrole"), F.lit("ORDER_0").alias("from"), F.concat(F.lit("LINE_"), F.when(F.col("k") % 7 == 0, F.lit("x")).otherwise(F.col("n").cast("string"))).alias("to"))
    labels = li.select(doc, seq, F.concat(F.lit("LINE_"), F.col("n").cast("string")).alias("label")).unionByName(li.select(doc, F.lit(0).alias("seq"), F.lit("ORDER_0").alias("label")).distinct())
    els = labels.select("doc_id", "seq", F.when(F.col("seq") == 0, "ORDER").when(F.col("seq") == 3, "ITEM").otherwise("LINE").alias("local_name"))
    roles = spark.createDataFrame([("urn:r/ORDER_HasPart_LINE",), ("urn:r/ORDER_Contains_LINE",)], "source_uri string")
    return arcs, labels, els, roles


_LI = "(SELECT DISTINCT l_orderkey k, l_linenumber n FROM lineitem)"


@query(f"SELECT k::VARCHAR AS graph_id, k || '/0' AS s, CASE WHEN k % 11 = 0 THEN 'ORDER_IsMade' WHEN k % 5 = 0 THEN 'ORDER_HasPart_LINE' ELSE 'ORDER_Contains_LINE' END AS p, k || '/' || n AS o FROM {_LI} WHERE k % 7 <> 0")
def lnk_resolve(spark, sf_dir):
    """LNK2."""
    arcs, labels, _, _ = _links(spark, sf_dir)
    nodes = labels.select("doc_id", "seq", F.concat_ws("/", "doc_id", F.col("seq").cast("string")).alias("iri"))
    return project.resolve_links(arcs, labels, nodes).select("graph_id", "s", _short(F.col("p")).alias("p"), "o")


@query(f"SELECT k::VARCHAR AS doc_id, 'missing-endpoint' AS error_code, count(*) AS n FROM {_LI} WHERE k % 7 = 0 GROUP BY 1 UNION ALL SELECT k::VARCHAR, 'unknown-arcrole', count(*) FROM {_LI} WHERE k % 11 = 0 GROUP BY 1")
def lnk_findings(spark, sf_dir):
    """LNK3."""
    arcs, labels, _, roles = _links(spark, sf_dir)
    return project.link_findings(arcs, labels, roles).groupBy("doc_id", "error_code").agg(F.count("*").alias("n"))


@query(f"SELECT k::VARCHAR AS doc_id, n + 100 AS seq, 'ITEM' AS to_kind, 'LINE' AS wanted_to FROM {_LI} WHERE n = 3 AND k % 7 <> 0 AND k % 11 <> 0")
def lnk_disallowed(spark, sf_dir):
    """LNK4."""
    arcs, labels, els, _ = _links(spark, sf_dir)
    return project.disallowed_links(arcs, labels, els).select("doc_id", "seq", "to_kind", "wanted_to")


@query("SELECT l_orderkey::VARCHAR AS doc_id, count(*) AS n_arcs, count(*) AS n_labels FROM lineitem GROUP BY 1")
def lnk_arcs(spark, sf_dir):
    """LNK1: arcs and labels out of attribute rows."""
    li = st.table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")))
    doc = F.col("l_orderkey").cast("string").alias("doc_id")
    at = lambda seq, name, v: F.struct(seq.alias("seq"), F.lit(project.XLINK).alias("ns"), F.lit(name).alias("name"), v.alias("value"))
    seq = F.col("seq")
    rows = li.select(doc, F.explode(F.array(at(seq, "label", F.concat(F.lit("L"), seq.cast("string"))), at(seq + 100, "from", F.lit("L1")), at(seq + 100, "to", F.concat(F.lit("L"), seq.cast("string"))), at(seq + 100, "arcrole", F.lit("urn:r")))).alias("a")).select("doc_id", "a.*")
    arcs, labels = project.link_arcs(rows)
    return arcs.groupBy("doc_id").agg(F.count("*").alias("n_arcs")).join(labels.groupBy("doc_id").agg(F.count("*").alias("n_labels")), "doc_id")


# ---- lint and reports (LNT, RPT) -----------------------------------------------------------------------------------


@query(f"SELECT o_orderkey::VARCHAR AS graph_id, 'order-' || o_orderkey AS s FROM {ORDERS} WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def lnt_annotation(spark, sf_dir):
    """LNT1: a third of the orders has no label and a fifth a blank one."""
    key = F.col("o_orderkey").cast("string")
    label = F.when(F.col("o_orderkey") % 5 == 0, "  ").otherwise(F.col("o_orderpriority"))
    labels = st.table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(key.alias("graph_id"), F.concat(F.lit("order-"), key).alias("s"), F.lit(RDFS + "label").alias("p"), label.alias("o"))
    facts = st.star_graph(spark, sf_dir).select("graph_id", "s", "p", "o").unionByName(labels)
    return lint.missing_annotation(facts, T + "Appraisal", RDFS + "label")


@query(f"SELECT 'parts' AS graph_id, CASE WHEN p_partkey % 3 = 0 THEN 'urn:other#Part' ELSE '{T}Part ' END || p_partkey AS s, CASE WHEN p_partkey % 3 = 0 THEN 'foreign-namespace' ELSE 'invalid-local-name' END AS reason FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def lnt_foreign(spark, sf_dir):
    """LNT3: parts as classes, a third of another namespace, a fifth with a blank in the name."""
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "urn:other#Part").when(k % 5 == 0, T + "Part ").otherwise(T + "Part"), k.cast("string"))
    facts = st.table(spark, sf_dir, "part").select(F.lit("parts").alias("graph_id"), name.alias("s"), F.lit(st.TYPE).alias("p"), F.lit(OWL + "Class").alias("o"))
    return lint.foreign_terms(facts, [OWL + "Class"], T)


@query(f"SELECT count(*) AS n_declared, min('opinion-' || o_orderkey) AS first_iri, max('opinion-' || o_orderkey) AS last_iri, count(*) = 1 AS ok FROM {ORDERS} WHERE o_orderkey % 7 <> 0")
def lnt_single(spark, sf_dir):
    """LNT4: the opinions of all graphs, of which there should be one."""
    return lint.single_declaration(st.star_graph(spark, sf_dir), T + "OpinionOfValue")


@query("SELECT p_type AS resource_type, round(avg(CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE 1.0 END), 9) AS full_share, count(*) AS n FROM part GROUP BY p_type")
def lnt_provenance(spark, sf_dir):
    """LNT5."""
    origin = registry.provenance(F.lit("d"), F.when(F.col("p_size") % 5 != 0, "v"), F.lit("s"), F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    rows = st.table(spark, sf_dir, "part").select(F.col("p_type").alias("resource_type"), origin.alias("provenance"))
    return lint.missing_provenance(rows)[1].withColumn("full_share", F.round("full_share", 9))


def _samples(spark, sf_dir):
    """Orders as samples, brands of their parts as competencies (brands 1 to 5 have no shape)."""
    o = st.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("use_case"), F.col("o_orderstatus").alias("expected_result"), F.when(F.col("o_custkey") % 2 == 0, "done").otherwise("open").alias("validation_status"), F.lit("none").alias("projection_status"))
    li = st.table(spark, sf_dir, "lineitem").join(st.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    bridge = li.select(F.col("l_orderkey").alias("sample_id"), F.when(F.col("p_size") == 1, measure.PLACEHOLDER).otherwise(F.col("p_brand")).alias("competency_id")).distinct()
    comp = st.table(spark, sf_dir, "part").select(F.col("p_brand").alias("competency_id"), F.when(F.col("p_brand").rlike("#[1-5]$"), "-").otherwise("shape").alias("shape")).distinct()
    return o, bridge, comp


_BRIDGE = "(SELECT DISTINCT l_orderkey k, p_brand b FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <> 1)"


@query(f"SELECT p_brand AS competency_id, (SELECT count(DISTINCT k) FROM {_BRIDGE} WHERE b = p_brand) AS n_samples FROM (SELECT DISTINCT p_brand FROM part)")
def rpt_coverage(spark, sf_dir):
    """RPT1: samples per competency."""
    return measure.competency_coverage(*_samples(spark, sf_dir))[0]


@query(f"SELECT o_orderpriority AS use_case, count(DISTINCT b) AS n_competencies, count(DISTINCT o_orderkey) AS n_samples FROM orders LEFT JOIN {_BRIDGE} ON k = o_orderkey GROUP BY 1")
def rpt_use_cases(spark, sf_dir):
    """RPT1: per use case."""
    return measure.competency_coverage(*_samples(spark, sf_dir))[1]


@query(f"SELECT DISTINCT o_orderpriority AS use_case, b AS competency_id FROM orders JOIN {_BRIDGE} ON k = o_orderkey WHERE regexp_matches(b, '#[1-5]$')")
def rpt_gaps(spark, sf_dir):
    """RPT2."""
    return measure.competency_gaps(*_samples(spark, sf_dir)).select("use_case", "competency_id")


@query("SELECT o_orderpriority AS use_case, o_orderstatus AS expected_result, CASE WHEN o_custkey % 2 = 0 THEN 'done' ELSE 'open' END AS validation_status, 'none' AS projection_status, count(*) AS n_samples FROM orders GROUP BY ALL")
def rpt_status(spark, sf_dir):
    """RPT3."""
    return measure.sample_status_summary(_samples(spark, sf_dir)[0])


@query("SELECT event_type || ':' || floor(value / 10)::BIGINT AS signature, count(*) AS n, count(DISTINCT user_id) AS n_packages, count(DISTINCT user_id % 10) AS n_sources, count(DISTINCT user_id) >= 2 AND count(DISTINCT user_id % 10) >= 2 AS systemic FROM events WHERE event_type <> 'purchase' GROUP BY 1 ORDER BY n DESC, signature LIMIT 20")
def rpt_top_findings(spark, sf_dir):
    """RPT4."""
    return measure.top_findings(st.event_findings(spark, sf_dir), 20)


# ---- history and streams (HIS, STM) --------------------------------------------------------------------------------

_RUNS = f"""(SELECT user_id::VARCHAR AS package_id, {_RUN} AS run_id, max(ts) AS created_at, count(*) FILTER (event_type <> 'purchase') AS n_findings, count(*) FILTER (event_type IN ('error', 'signup')) = 0 AS passed,
  (user_id % 10)::VARCHAR AS source, CASE WHEN max(day(ts)) <= 10 THEN '1.0' WHEN max(day(ts)) <= 20 THEN '1.1' ELSE '1.2' END AS version FROM events GROUP BY user_id, {_RUN})"""


@query(f"SELECT package_id, arg_max(run_id, created_at) AS run_id, arg_max(passed, created_at) AS deliverable FROM {_RUNS} GROUP BY package_id")
def his_deliverable(spark, sf_dir):
    """HIS1."""
    return history.deliverable(st.event_runs(spark, sf_dir)).select("package_id", "run_id", "deliverable")


@query(f"""WITH d AS (SELECT created_at::DATE AS day, sum(n_findings)::DOUBLE / count(*) AS f FROM {_RUNS} GROUP BY 1)
  SELECT day::DATE AS day, round(f, 9) AS findings_per_run, round(f - lag(f) OVER (ORDER BY day), 9) AS change, round(avg(f) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 9) AS moving_average FROM d""")
def his_trend(spark, sf_dir):
    """HIS2."""
    t = history.quality_trend(st.event_runs(spark, sf_dir))
    return t.select("day", *[F.round(c, 9).alias(c) for c in ("findings_per_run", "change", "moving_average")])


@query(f"""WITH f AS (SELECT package_id, min(created_at) AS failed_at FROM {_RUNS} WHERE NOT passed GROUP BY 1)
  SELECT f.package_id, failed_at, min(created_at) AS repaired_at FROM f LEFT JOIN {_RUNS} r ON r.package_id = f.package_id AND passed AND created_at > failed_at GROUP BY ALL""")
def his_repair(spark, sf_dir):
    """HIS3."""
    return history.time_to_repair(st.event_runs(spark, sf_dir)).select("package_id", "failed_at", "repaired_at")


@query(f"SELECT substr(sha256(source), 1, 16) AS source_key, count(*) AS n_runs, round(avg(CASE WHEN passed THEN 0.0 ELSE 1.0 END), 9) AS error_rate, rank() OVER (ORDER BY avg(CASE WHEN passed THEN 0.0 ELSE 1.0 END))::INTEGER AS rank FROM {_RUNS} GROUP BY source HAVING count(*) >= 3")
def his_benchmark(spark, sf_dir):
    """HIS4."""
    return history.source_benchmark(st.event_runs(spark, sf_dir), 3).select("source_key", "n_runs", F.round("error_rate", 9).alias("error_rate"), "rank")


@query(f"WITH m AS (SELECT source, version, avg(n_findings) AS m FROM {_RUNS} GROUP BY ALL) SELECT source, version, round(m, 9) AS mean, round(m - lag(m) OVER (PARTITION BY source ORDER BY version), 9) AS change FROM m")
def his_versions(spark, sf_dir):
    """HIS5."""
    return history.version_comparison(st.event_runs(spark, sf_dir)).select("source", "version", F.round("mean", 9).alias("mean"), F.round("change", 9).alias("change"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) FILTER (event_type = 'view') AS info, count(*) FILTER (event_type = 'click') AS warning, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'signup') AS critical FROM events WHERE event_type <> 'purchase' GROUP BY 1")
def stm_severity(spark, sf_dir):
    """STM2: the stream's aggregation over all events (as a batch; tests run it as a stream)."""
    return intake.severity_counts(st.event_findings(spark, sf_dir))


@query("SELECT page_id::VARCHAR AS doc_id FROM pages WHERE NOT starts_with(regexp_replace(html, '^\\s+', ''), '<') UNION ALL SELECT doc_id::VARCHAR FROM documents WHERE NOT starts_with(regexp_replace(coalesce(text, ''), '^\\s+', ''), '<')")
def stm_packages(spark, sf_dir):
    """STM1: intake of documents and pages with the stream's code (as a batch; tests run it as a stream)."""
    a = st.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("xml_text"))
    b = st.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.col("html").alias("xml_text"))
    return intake.stream_packages(a.unionByName(b)).select("doc_id")
