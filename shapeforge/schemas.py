"""Table layouts of the library. Every table of instance data is keyed by document or graph."""

from __future__ import annotations

DOCUMENTS = "doc_id string, package_name string, content binary"
ELEMENTS = (
    "doc_id string, seq int, parent_seq int, depth int, ns string, local_name string, sibling_index int, "
    "path string, parent_path string, line int, col int, text string, n_children int"
)
ATTRIBUTES = "doc_id string, seq int, ns string, name string, value string"
COMPONENTS = (
    "owner string, name string, construct string, type_ref string, pos int, min_occurs int, max_occurs int, "
    "use string, fixed string, choice_id string, branch string"
)
TRIPLES = "graph_id string, s string, p string, o string, o_kind string, o_datatype string, o_lang string"
SHAPES = "shape string, target_class string, path string, kind string, value string, severity string"
FINDINGS = "doc_id string, severity string, message string, line int, col int, error_code string, data_location string"

SEVERITIES = ("info", "warning", "error", "critical")

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"
XSD_NS = "http://www.w3.org/2001/XMLSchema"
XSI_NS = "http://www.w3.org/2001/XMLSchema-instance"
#: Namespace of this library's own terms; every function that mints takes another one.
BASE = "https://example.org/reports/"
TERMS = BASE + "ontology#"
