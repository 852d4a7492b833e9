"""Documents to element tables, with places. The parser is the library's one Python helper; it runs over Arrow batches.

Where neither lines nor namespace bindings are asked for, documents become trees in C and the rows that follow from names and
nesting are made once for all documents of one form.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate
from xml.etree import ElementTree
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import strip

_CHILDREN_TYPE = "array<struct<name:string,n:int>>"
_ROW = (
    "doc_id string, kind string, seq int, parent_seq int, depth int, ns string, local_name string, sibling_index int, "
    "path string, parent_path string, bare_path string, line int, col int, text string, n_children int, "
    f"attrs array<struct<ns:string,name:string,value:string>>, message string, spaces array<struct<prefix:string,uri:string>>, children {_CHILDREN_TYPE}, "
    "own_id string, up_id string, again boolean, alike boolean"
)
_KINDS = dict(c.split(" ") for c in _ROW.split(", "))
_FLAT = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
#: Columns that say which facts of a document are equal, and what they are made from.
_SAMENESS = ("own_id", "up_id", "again", "alike")
_SAME_FROM = ("parent_seq", "local_name", "text", "n_children", "attrs")
#: Columns of lists, by the types of their structs' fields.
_LISTS = {"attrs": [("ns", pa.string()), ("name", pa.string()), ("value", pa.string())], "spaces": [("prefix", pa.string()), ("uri", pa.string())], "children": [("name", pa.string()), ("n", pa.int32())]}
#: Rows handed back at once.
_CHUNK = 20_000


@cache
def _split_name(name: str) -> tuple[str | None, str]:
    ns, _, local = name.rpartition("}")
    return (ns or None), local.rsplit(":", 1)[-1]


def _same(names: list, ups: list, texts: list, sizes: list, attrs: list) -> dict[str, list]:
    """The columns of ``_SAMENESS`` for a document's elements: the ``id`` of an element and of its parent; ``again``: a leaf without
    attributes that says what a sibling before it says; ``alike``: the document may say something twice in another way (elements
    that share an id or have one that looks like a hash, attributes of one name and value, an attribute and a child)."""
    ids, said, n_said, again, leaves = [], set(), 0, [False] * len(names), set()
    for i, given in enumerate(attrs):
        own = [v for _, name, v in given if name == "id"] if given else None
        ids.append(min(own) if own else None)
        for _, name, v in given:
            if name != "id":
                said.add((i, name, v))
                n_said += 1
        if ids[i]:
            said.add(ids[i])
            n_said += 1 + _HASHED.issuperset(ids[i])
        if not given and not sizes[i] and ups[i] is not None:
            leaf = (ups[i], names[i], texts[i] or "")
            again[i] = leaf in leaves
            leaves.add(leaf)
    alike = len(said) < n_said or not said.isdisjoint(leaves)
    return {"own_id": ids, "up_id": [None if u is None else ids[u] for u in ups], "again": again, "alike": [alike] * len(names)}


_HASHED = frozenset("0123456789abcdef")


def _parse_into(cols: dict[str, list], doc_id: str, content: bytes) -> None:
    """Adds a document's element rows to the columns asked for, or an ``error`` row alone if it is not well formed. Lines and columns
    count from 1. What nobody asked for is neither made nor kept."""
    parser = expat.ParserCreate(namespace_separator="}")
    parser.ordered_attributes = parser.buffer_text = True
    first = len(cols["seq"])
    seqs = cols["seq"]
    get = cols.get
    parents, depths, spaces_of, names, indexes, paths, ups, bares, lines, places, texts, sizes, attrs, spaces, children = (
        get(c) for c in ("parent_seq", "depth", "ns", "local_name", "sibling_index", "path", "parent_path", "bare_path", "line", "col", "text", "n_children", "attrs", "spaces", "children")
    )
    with_path, placed = paths is not None or ups is not None, lines is not None or places is not None
    later = [c for c in (texts, sizes, children) if c is not None]
    stack: list[tuple] = []
    top: dict[str, int] = {}
    bound: list[tuple] = []

    def bind(prefix, uri):
        bound.append((prefix or "", uri or ""))

    def start(name, given):
        ns, local = _split_name(name)
        if stack:
            up_seq, counts, _, up, up_bare = stack[-1]
        else:
            up_seq, counts, up, up_bare = None, top, "", ""
        counts[local] = n = counts.get(local, 0) + 1
        path = f"{up}/{local}[{n}]" if with_path else ""
        bare = f"{up_bare}/{local}" if bares is not None else ""
        seq = len(seqs) - first
        seqs.append(seq)
        if parents is not None:
            parents.append(up_seq)
        if depths is not None:
            depths.append(len(stack))
        if spaces_of is not None:
            spaces_of.append(ns)
        if names is not None:
            names.append(local)
        if indexes is not None:
            indexes.append(n)
        if paths is not None:
            paths.append(path)
        if ups is not None:
            ups.append(up)
        if bares is not None:
            bares.append(bare)
        if placed:
            if lines is not None:
                lines.append(parser.CurrentLineNumber)
            if places is not None:
                places.append(parser.CurrentColumnNumber + 1)
        if attrs is not None:
            attrs.append([(*_split_name(k), v) for k, v in zip(given[::2], given[1::2], strict=True)] if given else ())
        if spaces is not None:
            spaces.append(bound[:] if bound else ())
            bound.clear()
        for col in later:
            col.append(None)
        stack.append((seq, {}, [], path, bare))

    def end(_):
        seq, counts, found, _, _ = stack.pop()
        at = first + seq
        if texts is not None:
            texts[at] = found[0] if len(found) == 1 else "".join(found)
        if sizes is not None:
            sizes[at] = sum(counts.values()) if counts else 0
        if children is not None:
            children[at] = list(counts.items()) if counts else ()

    def chars(data):
        if stack:
            stack[-1][2].append(data)

    if spaces is not None:
        parser.StartNamespaceDeclHandler = bind
    parser.StartElementHandler, parser.EndElementHandler = start, end
    if texts is not None:
        parser.CharacterDataHandler = chars
    try:
        parser.Parse(content, True)
    except expat.ExpatError as e:
        made = {"seq": None, "path": "/", "line": e.lineno, "col": e.offset + 1, "message": str(e), "attrs": (), "spaces": (), "children": ()}
        for c, col in cols.items():
            if c not in ("doc_id", "kind", "message"):
                del col[first:]
                col.append(made.get(c))
        kind, message, n = "error", made["message"], 1
    else:
        kind, message, n = "element", None, len(seqs) - first
        if any(c in cols for c in _SAMENESS):
            for c, made in _same(*(cols[c][first:] for c in ("local_name", "parent_seq", "text", "n_children", "attrs"))).items():
                if c in cols:
                    cols[c] += made
    for c, value in (("doc_id", doc_id), ("kind", kind), ("message", message)):
        if c in cols:
            cols[c] += [value] * n


def _columns(names) -> dict[str, list]:
    return {c: [] for c in dict.fromkeys(["seq", *names, *(_SAME_FROM if any(c in _SAMENESS for c in names) else ())])}


def parse(doc_id: str, content: bytes, columns: tuple[str, ...] = tuple(_KINDS)) -> list[dict]:
    """The rows of one document."""
    cols = _columns(columns)
    _parse_into(cols, doc_id, content)
    lists = {c: [n for n, _ in fields] for c, fields in _LISTS.items()}
    full = {c: [[dict(zip(lists[c], x, strict=True)) for x in v] for v in cols[c]] if c in lists else cols[c] for c in columns}
    return [dict(zip(columns, values, strict=True)) for values in zip(*full.values(), strict=True)]


def _array(name: str, values: list) -> pa.Array:
    """A column of Arrow; lists of structs are put together from flat columns."""
    if name not in _LISTS:
        return pa.array(values, _FLAT[_KINDS[name]])
    flat = [x for v in values for x in v]
    fields = _LISTS[name]
    parts = [pa.array([x[i] for x in flat], kind) for i, (_, kind) in enumerate(fields)]
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, values))], pa.int32()), pa.StructArray.from_arrays(parts, names=[n for n, _ in fields]))


def _parser_of(columns: tuple[str, ...]):
    def batches_of(batches):
        for batch in batches:
            cols = _columns(columns)
            contents = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                _parse_into(cols, doc_id, contents[i].as_py() or b"")
                whole = len(cols["seq"]) // _CHUNK * _CHUNK
                if whole:
                    for at in range(0, whole, _CHUNK):
                        yield pa.RecordBatch.from_arrays([_array(c, cols[c][at : at + _CHUNK]) for c in columns], names=list(columns))
                    cols = {c: v[whole:] for c, v in cols.items()}
            if cols["seq"]:
                yield pa.RecordBatch.from_arrays([_array(c, cols[c]) for c in columns], names=list(columns))

    return batches_of


#: What a tree of C-made nodes gives; lines and bindings of prefixes need the parser's own events.
_OF_TREES = frozenset(_KINDS) - {"line", "col", "spaces"}
#: Columns that follow from names and nesting alone.
_OF_SHAPES = frozenset(_OF_TREES) - {"doc_id", "kind", "message", "text", "attrs", *_SAMENESS}
#: Element rows of the shapes that are kept from one document to the next.
_KEPT = 100_000


def _shape_rows(cols: dict[str, list], tags: list[str], sizes: list[int]) -> None:
    """Adds the rows of a tree given by its names and numbers of children in document order."""
    names, n = [_split_name(t.removeprefix("{")) for t in tags], len(tags)
    ups, depths, indexes, paths, bares, counts = [None] * n, [0] * n, [1] * n, [""] * n, [""] * n, [{} for _ in range(n)]
    above: list[list[int]] = []
    for i, (_, local) in enumerate(names):
        while above and not above[-1][1]:
            above.pop()
        up, path, bare = None, "", ""
        if above:
            up = above[-1][0]
            above[-1][1] -= 1
            counts[up][local] = indexes[i] = counts[up].get(local, 0) + 1
            path, bare = paths[up], bares[up]
        ups[i], depths[i] = up, 0 if up is None else depths[up] + 1
        paths[i], bares[i] = f"{path}/{local}[{indexes[i]}]", f"{bare}/{local}"
        above.append([i, sizes[i]])
    made = {
        "seq": lambda: range(n), "parent_seq": lambda: ups, "depth": lambda: depths, "ns": lambda: [x for x, _ in names], "local_name": lambda: [x for _, x in names],
        "sibling_index": lambda: indexes, "path": lambda: paths, "parent_path": lambda: ["" if u is None else paths[u] for u in ups], "bare_path": lambda: bares,
        "n_children": lambda: sizes, "children": lambda: [list(c.items()) for c in counts],
    }
    for c, col in cols.items():
        col += made[c]()


def _text_of(e) -> str:
    return "".join([e.text or "", *(x.tail or "" for x in e)]) if len(e) else e.text or ""


class _Shapes:
    """Trees seen before: documents of one form have the same rows but for their values, so these rows are made once and taken
    again by their numbers."""

    def __init__(self, columns: tuple[str, ...]):
        self.columns = columns
        self.fresh()

    def fresh(self) -> None:
        self.at: dict[tuple, np.ndarray] = {}
        self.cols = {c: [] for c in self.columns}
        self.arrays = {c: _array(c, []) for c in self.columns}
        self.size = self.built = 0

    def rows(self, tags: list[str], sizes: list[int]) -> np.ndarray:
        """The numbers of the shape's rows."""
        key = (*tags, *sizes)
        found = self.at.get(key)
        if found is None:
            _shape_rows(self.cols, tags, sizes)
            found = self.at[key] = np.arange(self.size, self.size + len(tags))
            self.size += len(tags)
        return found

    def taken(self, numbers: np.ndarray) -> dict[str, pa.Array]:
        if self.built != self.size:
            self.arrays = {c: pa.concat_arrays([self.arrays[c], _array(c, v)]) for c, v in self.cols.items()}
            self.cols, self.built = {c: [] for c in self.columns}, self.size
        return {c: a.take(pa.array(numbers)) for c, a in self.arrays.items()}


def _same_of(found: list, texts: list[str], attrs: list) -> dict[str, list]:
    """``_same`` of a tree's elements in document order."""
    place = {e: i for i, e in enumerate(found)}
    ups: list[int | None] = [None] * len(found)
    for i, e in enumerate(found):
        for c in e:
            ups[place[c]] = i
    return _same([_split_name(e.tag.removeprefix("{"))[1] for e in found], ups, texts, [len(e) for e in found], attrs)


def _tree_parser_of(columns: tuple[str, ...]):
    """``_parser_of`` for columns of ``_OF_TREES``: the tree is made in C and told apart from others by its names and its numbers of
    children. What is not well formed goes to the parser that reports it."""
    shaped = tuple(c for c in columns if c in _OF_SHAPES)
    sameness = tuple(c for c in columns if c in _SAMENESS)
    texts, attrs = "text" in columns, "attrs" in columns

    def batches_of(batches):
        shapes = _Shapes(shaped)

        def batches_from(ids, numbers, own):
            docs, rows = pa.array(np.repeat(np.arange(len(ids)), [len(x) for x in numbers])), np.concatenate(numbers)
            ids = pa.array(ids, pa.string())
            for at in range(0, len(rows), _CHUNK):
                made = shapes.taken(rows[at : at + _CHUNK]) | {c: _array(c, v[at : at + _CHUNK]) for c, v in own.items()}
                n = min(_CHUNK, len(rows) - at)
                made |= {"doc_id": ids.take(docs[at : at + n]), "kind": pa.repeat("element", n), "message": pa.nulls(n, pa.string())}
                yield pa.RecordBatch.from_arrays([made[c] for c in columns], names=list(columns))
            if shapes.size > _KEPT:
                shapes.fresh()

        for batch in batches:
            errors = _columns(columns)
            ids, numbers, n = [], [], 0
            own = {c: [] for c in (*sameness, *(c for c, wanted in (("text", texts), ("attrs", attrs)) if wanted))}
            contents = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                content = contents[i].as_py() or b""
                try:
                    found = list(ElementTree.fromstring(content).iter())
                except (ElementTree.ParseError, ValueError):
                    _parse_into(errors, doc_id, content)
                    continue
                ids.append(doc_id)
                numbers.append(shapes.rows([e.tag for e in found], [len(e) for e in found]))
                n += len(found)
                said = [_text_of(e) for e in found] if texts or sameness else []
                given = [[(*_split_name(k.removeprefix("{")), v) for k, v in e.items()] if e.attrib else () for e in found] if attrs or sameness else []
                if texts:
                    own["text"] += said
                if attrs:
                    own["attrs"] += given
                if sameness:
                    same = _same_of(found, said, given)
                    for c in sameness:
                        own[c] += same[c]
                if n >= _CHUNK:
                    yield from batches_from(ids, numbers, own)
                    ids, numbers, n, own = [], [], 0, {c: [] for c in own}
            if ids:
                yield from batches_from(ids, numbers, own)
            if errors["seq"]:
                yield pa.RecordBatch.from_arrays([_array(c, errors[c]) for c in columns], names=list(columns))

    return batches_of


def shredded(documents: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One pass of the parser: element and error rows together, of the given columns where not all are needed. Write or persist it
    before taking more than one part.

    ``children`` counts an element's children by name, so checks of counts look at one row each.
    """
    names = tuple(_KINDS) if columns is None else tuple(columns)
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("content").cast("binary").alias("content")).mapInArrow((_tree_parser_of if _OF_TREES.issuperset(names) else _parser_of)(names), ", ".join(f"{c} {_KINDS[c]}" for c in names))


def _alike_of(batches):
    for batch in batches:
        kept = []
        for content in batch.column(1):
            try:
                found = list(ElementTree.fromstring(content.as_py() or b"").iter())
            except (ElementTree.ParseError, ValueError):
                cols = _columns(("alike",))
                _parse_into(cols, "", content.as_py() or b"")
                kept.append(bool(cols["alike"][0]))
                continue
            kept.append(_same_of(found, [_text_of(e) for e in found], [[(*_split_name(k.removeprefix("{")), v) for k, v in e.items()] if e.attrib else () for e in found])["alike"][0])
        yield batch.filter(pa.array(kept, pa.bool_()))


def alike(documents: DataFrame) -> DataFrame:
    """``doc_id, content`` of the documents whose rows are ``alike``; no element row is made."""
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("content").cast("binary").alias("content")).mapInArrow(_alike_of, "doc_id string, content binary")


def _errors_of(batches):
    for batch in batches:
        found = []
        for doc_id, content in zip(batch.column(0), batch.column(1), strict=True):
            try:
                expat.ParserCreate(namespace_separator="}").Parse(content.as_py() or b"", True)
            except expat.ExpatError as e:
                found.append((doc_id.as_py(), "error", "/", e.lineno, e.offset + 1, str(e)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, _FLAT[_KINDS[n]]) for n, c in zip(_ERROR, zip(*found, strict=True), strict=True)], names=list(_ERROR))


_ERROR = ("doc_id", "kind", "path", "line", "col", "message")


def unparsed(documents: DataFrame) -> DataFrame:
    """The error rows of ``shredded`` alone: no element row is made."""
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("content").cast("binary").alias("content")).mapInArrow(_errors_of, ", ".join(f"{c} {_KINDS[c]}" for c in _ERROR))


def elements(rows: DataFrame) -> DataFrame:
    """DOC2: the element table."""
    return rows.where("kind = 'element'").drop("kind", "attrs", "message", "spaces")


def attributes(rows: DataFrame) -> DataFrame:
    """DOC2: the attribute table."""
    return rows.where("kind = 'element'").select("doc_id", "seq", F.explode("attrs").alias("a")).select("doc_id", "seq", "a.ns", "a.name", "a.value")


def namespaces(rows: DataFrame) -> DataFrame:
    """Namespace bindings where they are declared: ``doc_id, path, prefix, uri`` (``''``: the default namespace, or none)."""
    return rows.where("kind = 'element'").select("doc_id", "path", F.explode("spaces").alias("b")).select("doc_id", "path", "b.prefix", "b.uri")


def parse_findings(rows: DataFrame) -> DataFrame:
    """DOC3: exactly one error finding for each document that is not well formed."""
    return rows.where("kind = 'error'").select("doc_id", F.lit("error").alias("severity"), "message", "line", "col", F.lit("not-well-formed").alias("error_code"), F.col("path").alias("data_location"))


def with_sibling_index(nodes: DataFrame, doc: str = "doc_id", parent: str = "parent_seq", name: str = "local_name", order: str = "seq") -> DataFrame:
    """DOC4: place among the parent's children of the same name, from 1."""
    return nodes.withColumn("sibling_index", F.row_number().over(Window.partitionBy(doc, parent, name).orderBy(order)))


#: Fixed texts of the finding for a package that can't be read.
UNREADABLE = {
    "observed_value": "empty or non-XML payload",
    "expected_condition": "A readable XML report package",
    "finding": "Submitted package is not a readable XML document.",
}


def unreadable_packages(packages: DataFrame) -> DataFrame:
    """DOC1: a finding for every package whose text is null, blank or doesn't start with ``<``."""
    bad = F.col("xml_text").isNull() | ~F.coalesce(strip(F.col("xml_text")), F.lit("")).startswith("<")
    return packages.where(bad).select(
        "doc_id", "package_name", F.lit("error").alias("severity"), F.col("investor_scope").alias("investor"), F.lit("schema").alias("rule_type"),
        F.lit("/").alias("data_location"), *[F.lit(v).alias(k) for k, v in UNREADABLE.items()], F.lit(False).alias("requires_human_review"),
    )
