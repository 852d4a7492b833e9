"""Schema sets: what schema files declare, over includes and imports, groups and inheritance, as the tables that checks join.

A schema set is a root file and all files that it includes or imports, to the fixpoint and for all roots at once; names are
resolved in (set, namespace, name). A file without a target namespace takes that of the file that includes it. References to
groups and attribute groups are replaced by what those hold, an extension stands behind the content of its base, a restriction
in place of it. All of this is joins on executors; only the content of one type at a time is walked, in ``_compiled``: it
numbers the places, names choices and branches and works out which child may follow which.

Keys of types are ``set|{namespace}name``, ``set|{namespace}#file:seq`` for types without a name, and the bare local name for
built-in types, so they are unique over all sets and the checks of ``conform`` need no other key.

Where the head of a substitution group may stand, a choice of all that may stand for it is declared, to any depth of the group; abstract
heads are no branch of it and no root. A union whose members have facets or lists of values keeps them apart, an alternative a member.

Left out: redefinitions, identity constraints, ``xsi:type``; a wildcard admits any child.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import documentation_text
from ..schemas import XSD_NS
from .conform import ROOT
from .fixpoint import grown, stored

_NAMES = ("name", "ref", "type", "base", "minOccurs", "maxOccurs", "use", "fixed", "value", "schemaLocation", "namespace", "targetNamespace", "memberTypes", "substitutionGroup", "abstract")
_COMPOSITORS = ("sequence", "choice", "all")
FACETS = ("length", "minLength", "maxLength", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "fractionDigits", "totalDigits", "pattern", "enumeration", "whiteSpace")
#: First and last mark of a type's children in ``follows``.
START, END = "^", "$"
#: The place of a child that may be anything.
ANY = "*"


def _true(column: str) -> Column:
    return F.coalesce(F.col(column).isin("true", "1"), F.lit(False))


def schema_nodes(elements: DataFrame, attributes: DataFrame) -> DataFrame:
    """``file, seq, parent_seq, depth, path, parent_path, construct`` and a column ``a_*`` per attribute that schemas use."""
    own = attributes.where(F.col("ns").isNull() & F.col("name").isin(*_NAMES)).groupBy("doc_id", "seq").pivot("name", list(_NAMES)).agg(F.first("value"))
    rows = elements.where(F.col("ns") == XSD_NS).join(own, ["doc_id", "seq"], "left")
    return rows.select(F.col("doc_id").alias("file"), "seq", "parent_seq", "depth", "path", "parent_path", F.col("local_name").alias("construct"), *[F.col(f"`{a}`").alias(f"a_{a}") for a in _NAMES])


def joined_location(file: Column, location: Column) -> Column:
    """A location relative to a file's folder, without ``.`` and ``..``; absolute ones stay."""
    folder = F.regexp_extract(file, r"\A(.*/)?", 0)
    steps = F.split(F.concat(folder, location), "/", -1)
    none = F.array().cast("array<string>")
    walked = F.aggregate(
        steps, none, lambda a, s: F.when(s == ".", a).when((s == "..") & (F.size(a) > 0) & (F.element_at(a, F.greatest(F.size(a), F.lit(1))) != ".."), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    )
    return F.when(location.rlike(r"\A(?:/|[A-Za-z][A-Za-z0-9+.-]*:)"), location).otherwise(F.array_join(walked, "/"))


def schema_files(nodes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """SCH4: ``set_id, file, space, depth, present`` of every root (all files, or the ``file`` column of ``roots``): what it includes and
    imports, to the fixpoint; ``depth`` is the least number of steps. A file's ``space`` is its target namespace, else its includer's."""
    heads = nodes.where("depth = 0").select("file", F.coalesce("a_targetNamespace", F.lit("")).alias("tns"))
    step = nodes.where("construct in ('include', 'import', 'redefine') and a_schemaLocation is not null")
    step = step.select("file", joined_location(F.col("file"), F.col("a_schemaLocation")).alias("target"), F.when(F.col("construct") == "import", F.coalesce("a_namespace", F.lit(""))).alias("imported")).distinct()
    edges = step.join(heads.select(F.col("file").alias("target"), "tns", F.lit(True).alias("found")), "target", "left")
    edges = edges.select("file", "target", "imported", F.coalesce("tns", F.lit("")).alias("tns"), F.coalesce("found", F.lit(False)).alias("found")).persist()
    start = (heads if roots is None else heads.join(roots.select("file").distinct(), "file")).select(F.col("file").alias("set_id"), "file", F.col("tns").alias("space"), F.lit(0).alias("depth"), F.lit(True).alias("present"))

    def further(front: DataFrame) -> DataFrame:
        space = F.when(F.col("tns") != "", F.col("tns")).otherwise(F.coalesce("imported", "space"))
        out = front.select("set_id", "file", "space", "depth").join(edges, "file").select("set_id", F.col("target").alias("file"), space.alias("space"), (F.col("depth") + 1).alias("depth"), F.col("found").alias("present"))
        return out.groupBy("set_id", "file", "space").agg(F.min("depth").alias("depth"), F.max("present").alias("present"))

    found = grown(start, further, ["set_id", "file", "space"])
    edges.unpersist()
    return found


def _resolved(uses: DataFrame, spaces: DataFrame) -> DataFrame:
    """``uses`` (``file, path, space, name``: a prefixed name) with ``uri`` and ``local``: the prefix as bound nearest above."""
    prefix = F.when(F.col("name").contains(":"), F.substring_index("name", ":", 1)).otherwise("")
    rows = uses.withColumn("prefix", prefix).withColumn("local", F.substring_index("name", ":", -1))
    keys = rows.select("file", "path", "prefix").distinct()
    bound = spaces.select(F.col("doc_id").alias("file"), F.col("path").alias("at"), "prefix", "uri")
    near = keys.join(bound, ["file", "prefix"]).where((F.col("path") == F.col("at")) | F.col("path").startswith(F.concat("at", F.lit("/")))).groupBy("file", "path", "prefix").agg(F.max_by("uri", F.length("at")).alias("uri"))
    rows = rows.join(near, ["file", "path", "prefix"], "left")
    # no default namespace: the file's own, which an including file may have lent it
    return rows.withColumn("uri", F.when(F.col("uri").isNotNull() & (F.col("uri") != ""), F.col("uri")).when(F.col("prefix") == "xml", "http://www.w3.org/XML/1998/namespace").otherwise(F.col("space"))).drop("prefix")


def _key(set_id: Column | str, uri: Column | str, local: Column | str) -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.when(col(uri) == XSD_NS, col(local)).otherwise(F.concat(col(set_id), F.lit("|{"), col(uri), F.lit("}"), col(local)))


@dataclass
class SchemaSets:
    """Tables of all schema sets. Key of each: ``set_id`` and the type keys, which hold it too."""

    files: DataFrame  # set_id, file, space, depth, present
    types: DataFrame  # set_id, type_ref, name, kind (complex or simple), base, derivation (extension or restriction), abstract, doc
    declarations: DataFrame  # set_id, owner, name, type_ref, pos, min_occurs, max_occurs, fixed, choice_id, branch
    follows: DataFrame  # set_id, owner, before, after: children that may stand next to each other
    attributes: DataFrame  # set_id, owner, name, type_ref, use, fixed
    unions: DataFrame  # type_ref, member: built-in types any of which a value may have
    facets: DataFrame  # type_ref, facet, limit
    values: DataFrame  # type_ref, value
    alternatives: DataFrame  # type_ref, alternatives: of unions with restricted members, see ``_alternatives``

    @property
    def wildcards(self) -> DataFrame:
        """Types that admit any child."""
        return self.declarations.where(F.col("name") == ANY).select("owner").distinct()


def _owners(nodes: DataFrame) -> DataFrame:
    """``file, seq, c_seq``: the nearest type or group above each node (a node that is one has its own above it)."""
    kinds = ("complexType", "simpleType", "group", "attributeGroup")
    held = nodes.where(F.col("construct").isin(*kinds) & (F.col("a_ref").isNull())).select("file", F.col("path").alias("at"), F.col("seq").alias("c_seq"))
    steps = F.split("parent_path", "/", -1)
    up = nodes.where("depth > 0").select("file", "seq", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(steps), F.lit(2))), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("at"))
    return up.join(held, ["file", "at"]).groupBy("file", "seq").agg(F.max_by("c_seq", F.length("at")).alias("c_seq"))


def _substitutes(globals_: DataFrame, heads: DataFrame) -> DataFrame:
    """``member, head, distance``: which global elements (``ref``) may stand for which, each for itself at distance 0. ``heads``: ``at,
    above``, the group that an element names."""
    start = globals_.where("construct = 'element'").select(F.col("ref").alias("member"), F.col("ref").alias("head"), F.lit(0).alias("distance"))
    return grown(start, lambda f: f.join(heads, F.col("head") == F.col("at")).select("member", F.col("above").alias("head"), (F.col("distance") + 1).alias("distance")), ["member", "head"])


def _heads_opened(parts: DataFrame, globals_: DataFrame, group: DataFrame) -> DataFrame:
    """``parts`` with a choice in place of each reference (``head``) to an element that others may stand for, or that is abstract."""
    elements = globals_.where("construct = 'element'").select(F.col("ref").alias("member"), "r_name", "r_type", "r_fixed", "r_abstract")
    swapped = group.where("distance > 0").select("head").unionByName(elements.where("r_abstract").select(F.col("member").alias("head"))).distinct().withColumn("swap", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("head").orderBy("distance", "member"))
    branches = group.join(elements.where("not r_abstract"), "member").select("head", "r_name", "r_type", "r_fixed", nth.alias("nth"))
    rows, _ = stored(parts.join(swapped, "head", "left"))
    made = rows.where("swap").drop("name", "type_ref", "fixed").join(branches, "head").withColumns({
        "up": F.col("key"), "key": F.concat("key", F.array("nth")), "construct": F.lit("element"), "name": F.col("r_name"), "type_ref": F.coalesce("r_type", F.lit("anyType")), "fixed": F.col("r_fixed"), "min_occurs": F.lit(1), "max_occurs": F.lit(1),
    })
    kept = rows.withColumns({"construct": F.when(F.col("swap"), "choice").otherwise(F.col("construct")), **{c: F.when(F.col("swap").isNull(), F.col(c)) for c in ("name", "type_ref", "fixed")}})
    return kept.select(*parts.columns).unionByName(made.select(*parts.columns))


_ALTERNATIVES = "type_ref string, alternatives array<struct<kind:string,facets:array<struct<facet:string,limit:string>>,listed:array<string>>>"


def _alternatives(ancestors: DataFrame, bases: DataFrame, members: DataFrame, unions: DataFrame, facets: DataFrame, values: DataFrame) -> DataFrame:
    """For each type with a union above it, the types that a value may have: the built-in type, facets and list (null: none) of each member
    that is no union itself. Only types of which some member has facets or a list: for others ``unions`` tells all."""
    mixed = ancestors.join(members.select(F.col("type_ref").alias("from")).distinct(), "from", "left_semi").select(F.col("owner").alias("type_ref")).distinct().persist()
    plain = bases.join(mixed, "type_ref", "left_semi").join(members, "type_ref", "left_anti").select("type_ref", "base")
    ways = members.unionByName(plain).select(F.col("type_ref").alias("at"), F.col("base").alias("next")).persist()
    found = grown(mixed.select("type_ref", F.col("type_ref").alias("leaf")), lambda f: f.join(ways, F.col("leaf") == F.col("at")).select("type_ref", F.col("next").alias("leaf")), ["type_ref", "leaf"])
    leaves = found.join(mixed.select(F.col("type_ref").alias("leaf")), "leaf", "left_anti")
    kinds = unions.groupBy(F.col("type_ref").alias("leaf")).agg(F.min("member").alias("kind"))
    limits = facets.groupBy(F.col("type_ref").alias("leaf")).agg(F.collect_list(F.struct("facet", "limit")).alias("facets"))
    lists = values.groupBy(F.col("type_ref").alias("leaf")).agg(F.collect_list("value").alias("listed"))
    rows = leaves.join(kinds, "leaf", "left").join(limits, "leaf", "left").join(lists, "leaf", "left")
    kind = F.coalesce("kind", F.when(~F.col("leaf").contains("|"), F.col("leaf")))
    one = F.struct(kind.alias("kind"), F.coalesce("facets", F.array().cast("array<struct<facet:string,limit:string>>")).alias("facets"), "listed")
    out = rows.groupBy("type_ref").agg(F.collect_list(one).alias("alternatives"))
    return out.where(F.exists("alternatives", lambda a: (F.size(a["facets"]) > 0) | a["listed"].isNotNull()))


_LEAF = "set_id string, owner string, pos int, name string, type_ref string, min_occurs int, max_occurs int, fixed string, choice_id string, branch string, before string, after string"


def _compiled(pdf: pd.DataFrame) -> pd.DataFrame:
    """The content of one type: its children in order (rows with a name) and which may follow which (rows with ``before``).

    ``pdf``: a row a particle: ``key`` (its place among all), ``up`` (key of the one above; none at the top), construct, occurrence.
    The rules for first, last and following children are those of Glushkov's automaton, a child's name standing for its place: where a
    name stands at several places of one type, what may follow any of them may follow it.
    """
    set_id, owner = pdf["set_id"].iloc[0], pdf["owner"].iloc[0]
    rows = sorted(pdf.to_dict("records"), key=lambda r: tuple(r["key"]))
    below: dict[tuple, list] = {}
    for r in rows:
        below.setdefault(tuple(r["up"]), []).append(r)
    leaves: list[dict] = []
    pairs: set[tuple[str, str]] = set()
    pos = 0

    def walk(r, at, choice, optional, times):
        """(nullable, first names, last names); ``at`` is the place that members of a choice or loop share, if any."""
        nonlocal pos
        low = 1 if r["min_occurs"] != r["min_occurs"] or r["min_occurs"] is None else int(r["min_occurs"])
        high = None if r["max_occurs"] is None or r["max_occurs"] != r["max_occurs"] else int(r["max_occurs"])
        loops = high is None or high > 1
        product = lambda a, b: None if a is None or b is None else a * b
        if r["construct"] in ("element", "any"):
            if at is None:
                pos += 1
            name = ANY if r["construct"] == "any" else r["name"]
            leaves.append({
                "name": name, "type_ref": r["type_ref"], "pos": pos if at is None else at, "min_occurs": 0 if optional else low * times[0], "max_occurs": product(high, times[1]),
                "fixed": r["fixed"], "choice_id": choice[0], "branch": choice[1],
            })
            if loops:
                pairs.add((name, name))
            return low == 0, {name}, {name}
        kind = r["construct"]
        if at is None and (kind != "sequence" or loops):
            pos += 1
            at = pos
        times = (times[0] * low, product(times[1], high))
        # a choice that may repeat admits any of its branches again
        free = loops or times[1] is None or times[1] > 1
        empty, first, last = kind != "choice", set(), set()
        followed: set[str] = set()
        for child in below.get(tuple(r["key"]), []):
            own, soft = choice, optional or low == 0
            if kind == "choice":
                if free:
                    soft = True
                elif choice[0] is None:
                    own = (f"{owner}/{'.'.join(map(str, r['key']))}", ".".join(map(str, child["key"])))
                    soft = low == 0
                else:
                    soft = True
            none, a, b = walk(child, at, own, soft, times)
            if kind == "sequence":
                pairs.update((x, y) for x in followed for y in a)
                if empty:
                    first |= a
                followed = followed | b if none else b
                empty = empty and none
            else:
                first |= a
                last |= b
                empty = empty and none if kind == "all" else empty or none
        if kind == "sequence":
            last = followed
        if kind == "all":
            pairs.update((x, y) for x in last for y in first)
        if loops:
            pairs.update((x, y) for x in last for y in first)
        if kind == "choice" and not below.get(tuple(r["key"])):
            empty = True
        return empty or low == 0, first, last

    top = {"construct": "sequence", "key": (), "min_occurs": 1, "max_occurs": 1}
    empty, first, last = walk(top, None, (None, None), False, (1, 1))
    pairs |= {(START, x) for x in first} | {(x, END) for x in last} | ({(START, END)} if empty else set())
    names = [c.split(" ")[0] for c in _LEAF.split(", ")]
    out = [[{"set_id": set_id, "owner": owner, **r}.get(c) for c in names] for r in [*leaves, *({"before": x, "after": y} for x, y in sorted(pairs))]]
    return pd.DataFrame(out, columns=names, dtype=object)


def schema_sets(elements: DataFrame, attributes: DataFrame, namespaces: DataFrame, roots: DataFrame | None = None) -> SchemaSets:
    """SCH3, SCH4: all declarations of the sets of ``roots`` (a table with a ``file`` column; all files by default)."""
    nodes, _ = stored(schema_nodes(elements, attributes))
    files = schema_files(nodes, roots)
    here = files.where("present").select("set_id", "file", "space")
    own, _ = stored(nodes.join(_owners(nodes), ["file", "seq"], "left"))

    def named(rows: DataFrame, column: str, made: str) -> DataFrame:
        """``set_id, file, seq`` and the key of what ``column`` names."""
        uses = rows.where(F.col(column).isNotNull()).join(here, "file").select("set_id", "file", "space", "path", "seq", F.col(column).alias("name"))
        return _resolved(uses, namespaces).select("set_id", "file", "seq", _key("set_id", "uri", "local").alias(made))

    # types and groups by their keys
    boxes = own.where("construct in ('complexType', 'simpleType') or (construct in ('group', 'attributeGroup') and a_ref is null)").join(here, "file")
    local = F.coalesce("a_name", F.concat(F.lit("#"), "file", F.lit(":"), F.col("seq").cast("string")))
    boxes, _ = stored(boxes.select("set_id", "file", "seq", "parent_seq", "path", "construct", "a_name", "a_abstract", "depth", _key("set_id", "space", local).alias("key")))
    # a type's derivation: the restriction or extension nearest below, whatever content element stands between
    derived = own.where("construct in ('restriction', 'extension', 'union', 'list') and c_seq is not null")
    links = named(derived, "a_base", "base").join(derived.select("file", "seq", "c_seq", "construct"), ["file", "seq"])
    links = links.select("set_id", "file", F.col("c_seq").alias("seq"), "base", F.col("construct").alias("derivation")).dropDuplicates(["set_id", "file", "seq"])
    # inline simple types below a restriction stand for its base, those below a union for members
    inline = boxes.where("construct = 'simpleType' and a_name is null").select("set_id", "file", F.col("parent_seq").alias("seq"), F.col("key").alias("inner")).join(derived.select("file", "seq", "c_seq", "construct"), ["file", "seq"])
    docs = own.where("construct = 'annotation'").select("file", F.col("seq").alias("parent_seq"), F.col("parent_seq").alias("at"))
    texts = elements.where((F.col("ns") == XSD_NS) & (F.col("local_name") == "documentation")).select(F.col("doc_id").alias("file"), "parent_seq", F.col("seq").alias("d_seq"), F.coalesce("text", F.lit("")).alias("text")).join(docs, ["file", "parent_seq"])
    texts = texts.groupBy("file", F.col("at").alias("seq")).agg(documentation_text(F.array_sort(F.collect_list(F.struct("d_seq", "text"))).getField("text")).alias("doc"))
    under = inline.where("construct = 'restriction'").select("set_id", "file", F.col("c_seq").alias("seq"), F.col("inner").alias("under")).dropDuplicates(["set_id", "file", "seq"])
    types = boxes.where("construct in ('complexType', 'simpleType')").join(links, ["set_id", "file", "seq"], "left").join(under, ["set_id", "file", "seq"], "left").join(texts, ["file", "seq"], "left")
    types = types.select(
        "set_id", F.col("key").alias("type_ref"), F.col("a_name").alias("name"), F.when(F.col("construct") == "complexType", "complex").otherwise("simple").alias("kind"), F.coalesce("base", "under").alias("base"),
        F.coalesce("derivation", F.when(F.col("under").isNotNull(), "restriction")).alias("derivation"), _true("a_abstract").alias("abstract"), "doc",
    )
    types, _ = stored(types.dropDuplicates(["type_ref"]))

    # particles and attributes with the key of what holds them
    keyed = boxes.select("set_id", "file", F.col("seq").alias("c_seq"), F.col("key").alias("owner"), F.col("construct").alias("box"))
    inner = boxes.where("a_name is null and construct in ('complexType', 'simpleType')").select("set_id", "file", F.col("parent_seq").alias("seq"), F.col("key").alias("inline")).dropDuplicates(["set_id", "file", "seq"])
    uses = own.where("construct in ('element', 'attribute')")
    declared = uses.join(here, "file").select("set_id", "file", "space", "seq", "depth", "c_seq", "construct", "a_name", "a_fixed", "a_use", "a_abstract")
    declared = declared.join(named(uses, "a_type", "typed"), ["set_id", "file", "seq"], "left").join(inner, ["set_id", "file", "seq"], "left").join(named(uses, "a_ref", "ref"), ["set_id", "file", "seq"], "left")
    declared = declared.withColumn("type_ref", F.coalesce("typed", "inline"))
    declared = declared.withColumn("own", F.when((F.col("depth") == 1) & F.col("a_name").isNotNull(), _key("set_id", "space", "a_name")))
    globals_ = declared.where("own is not null").select("set_id", "construct", F.col("own").alias("ref"), F.col("a_name").alias("r_name"), F.col("type_ref").alias("r_type"), F.col("a_fixed").alias("r_fixed"), _true("a_abstract").alias("r_abstract")).dropDuplicates(["construct", "ref"])
    grouped = uses.where("construct = 'element' and depth = 1 and (a_substitutionGroup is not null or a_abstract in ('true', '1'))")
    group = None
    if grouped.limit(1).count():
        globals_, _ = stored(globals_)
        heads, _ = stored(declared.join(named(grouped, "a_substitutionGroup", "above"), ["set_id", "file", "seq"]).select(F.col("own").alias("at"), "above").distinct())
        group = _substitutes(globals_, heads)
        # an element without a type has that of the nearest head with one
        lent = globals_.where("construct = 'element' and r_type is not null").select(F.col("ref").alias("head"), F.col("r_type").alias("lent"))
        lent = group.where("distance > 0").join(lent, "head").groupBy(F.col("member").alias("ref")).agg(F.min_by("lent", "distance").alias("lent")).withColumn("construct", F.lit("element"))
        globals_, _ = stored(globals_.join(lent, ["construct", "ref"], "left").withColumn("r_type", F.coalesce("r_type", "lent")).drop("lent"))
    declared = declared.withColumn("head", F.when(F.col("construct") == "element", F.col("ref"))).withColumn("ref", F.coalesce("ref", "own")).join(globals_, ["set_id", "construct", "ref"], "left")
    # references to what no file declares keep their local name
    bare = F.regexp_replace(F.element_at(F.split("ref", "[|]"), -1), r"\A\{[^}]*\}", "")
    plain = {"element": "anyType", "attribute": "anySimpleType"}
    kind = F.coalesce("type_ref", "r_type", F.create_map(*[F.lit(x) for kv in plain.items() for x in kv])[F.col("construct")])
    declared, _ = stored(declared.select("set_id", "file", "seq", "depth", "c_seq", "construct", F.coalesce("a_name", "r_name", bare).alias("name"), kind.alias("type_ref"), F.coalesce("a_fixed", "r_fixed").alias("fixed"), "a_use", "head", _true("a_abstract").alias("abstract")))

    # the content of a box, in keys of arrays: a reference's content gets the reference's key in front
    up = own.where(F.col("construct").isin(*_COMPOSITORS, "element", "any", "group") & F.col("c_seq").isNotNull() & ~((F.col("construct") == "group") & F.col("a_ref").isNull()))
    compositors = up.where(F.col("construct").isin(*_COMPOSITORS)).select("file", F.col("seq").alias("parent_seq"), F.lit(True).alias("inside"))
    count = lambda c: F.when(F.col(c) == "unbounded", None).otherwise(F.coalesce(F.col(c).cast("int"), F.lit(1)))
    parts = up.join(compositors, ["file", "parent_seq"], "left").join(keyed, ["file", "c_seq"]).where("box in ('complexType', 'group')")
    parts = parts.join(declared.where("construct = 'element'").select("set_id", "file", "seq", "name", "type_ref", "fixed", "head"), ["set_id", "file", "seq"], "left").join(named(up.where("construct = 'group'"), "a_ref", "ref"), ["set_id", "file", "seq"], "left")
    none = F.array().cast("array<int>")
    parts = parts.select(
        "set_id", "owner", "box", F.array("seq").alias("key"), F.when(F.col("inside"), F.array("parent_seq")).otherwise(none).alias("up"), F.when(F.col("construct") == "group", "sequence").otherwise(F.col("construct")).alias("construct"),
        "name", "type_ref", "fixed", count("a_minOccurs").alias("min_occurs"), count("a_maxOccurs").alias("max_occurs"), "ref", F.array().cast("array<string>").alias("trail"), "head",
    )
    parts, _ = stored((parts if group is None else _heads_opened(parts, globals_, group)).drop("head"))
    groups = parts.where("box = 'group'").select(F.col("owner").alias("g_owner"), *[F.col(c).alias(f"g_{c}") for c in ("key", "up", "construct", "name", "type_ref", "fixed", "min_occurs", "max_occurs", "ref")])

    def opened(front: DataFrame) -> DataFrame:
        rows = front.where(F.col("ref").isNotNull() & ~F.array_contains("trail", F.coalesce("ref", F.lit("")))).join(groups, F.col("ref") == F.col("g_owner"))
        return rows.select(
            "set_id", "owner", "box", F.concat("key", "g_key").alias("key"), F.when(F.size("g_up") > 0, F.concat("key", "g_up")).otherwise(F.col("key")).alias("up"), F.col("g_construct").alias("construct"), F.col("g_name").alias("name"),
            F.col("g_type_ref").alias("type_ref"), F.col("g_fixed").alias("fixed"), F.col("g_min_occurs").alias("min_occurs"), F.col("g_max_occurs").alias("max_occurs"), F.col("g_ref").alias("ref"), F.concat("trail", F.array("ref")).alias("trail"),
        )

    content = grown(parts.where("box = 'complexType'"), opened, ["owner", "key"])

    # inheritance: (type, ancestor, distance); content comes over extensions only, attributes over both
    bases = types.where("base is not null").select("type_ref", "base", "derivation").persist()
    start = types.select("set_id", F.col("type_ref").alias("owner"), F.col("type_ref").alias("from"), F.lit(0).alias("distance"), F.lit(True).alias("content"))

    def higher(front: DataFrame) -> DataFrame:
        return front.join(bases, F.col("from") == F.col("type_ref")).select("set_id", "owner", F.col("base").alias("from"), (F.col("distance") + 1).alias("distance"), (F.col("content") & (F.col("derivation") == "extension")).alias("content"))

    ancestors = grown(start, higher, ["owner", "from"])
    whole = ancestors.where("content").select("owner", "distance", F.col("from")).join(content.select("set_id", F.col("owner").alias("from"), "key", "up", "construct", "name", "type_ref", "fixed", "min_occurs", "max_occurs"), "from")
    # a type's parts: base content first, so the key of an inherited part begins with minus its distance
    front = F.array(-F.col("distance"))
    whole = whole.select("set_id", "owner", F.concat(front, "key").alias("key"), F.when(F.size("up") > 0, F.concat(front, "up")).otherwise(none).alias("up"), "construct", "name", "type_ref", "fixed", "min_occurs", "max_occurs")
    shut = types.where("kind = 'complex'").select("set_id", F.col("type_ref").alias("owner"))
    compiled, _ = stored(whole.groupBy("set_id", "owner").applyInPandas(_compiled, _LEAF))
    top = declared.where("depth = 1 and construct = 'element' and not abstract").select("set_id", F.lit(ROOT).alias("owner"), "name", "type_ref", F.lit(1).alias("pos"), F.lit(0).alias("min_occurs"), F.lit(1).alias("max_occurs"), "fixed", F.lit(None).cast("string").alias("choice_id"), F.lit(None).cast("string").alias("branch"))
    cols = top.columns
    declarations = top.dropDuplicates(["set_id", "name"]).unionByName(compiled.where("name is not null").select(*cols))
    bare_types = shut.join(compiled.select("owner").distinct(), "owner", "left_anti").select("set_id", "owner", F.lit(START).alias("before"), F.lit(END).alias("after"))
    follows = compiled.where("before is not null").select("set_id", "owner", "before", "after").unionByName(bare_types)

    # attributes: own ones, those of referred groups, then those of bases; the nearest declaration of a name counts
    held = own.where("construct = 'attributeGroup' and a_ref is not null and c_seq is not null")
    refs = named(held, "a_ref", "ref").join(held.select("file", "seq", "c_seq"), ["file", "seq"]).join(keyed, ["set_id", "file", "c_seq"]).select("set_id", "owner", F.col("ref").alias("group"))
    reach = grown(boxes.where("construct in ('complexType', 'attributeGroup')").select("set_id", F.col("key").alias("owner"), F.col("key").alias("group")).dropDuplicates(["owner"]), lambda f: f.select("set_id", "owner", F.col("group").alias("at")).join(refs.select(F.col("owner").alias("at"), "group"), "at"), ["owner", "group"])
    direct = declared.where("construct = 'attribute' and c_seq is not null").join(keyed, ["set_id", "file", "c_seq"]).select(F.col("owner").alias("group"), "name", "type_ref", F.coalesce("a_use", F.lit("optional")).alias("use"), "fixed")
    mine = reach.join(direct, "group").select(F.col("owner").alias("from"), "name", "type_ref", "use", "fixed")
    all_ = ancestors.join(mine, "from").select("set_id", "owner", "distance", "name", "type_ref", "use", "fixed")
    nearest = Window.partitionBy("owner", "name").orderBy("distance", "type_ref", "use")
    attributes_ = all_.withColumn("n", F.row_number().over(nearest)).where("n = 1 and use <> 'prohibited'").select("set_id", "owner", "name", "type_ref", "use", "fixed")

    # values: built-in members over restrictions and unions, facets and lists over restrictions alone
    member_names = own.where("construct = 'union' and a_memberTypes is not null and c_seq is not null").select("file", "path", "seq", "c_seq", F.explode(F.split(F.trim("a_memberTypes"), r"\s+")).alias("a_member"))
    spelled = _resolved(member_names.join(here, "file").select("set_id", "file", "space", "path", "seq", "c_seq", F.col("a_member").alias("name")), namespaces).select("set_id", "file", F.col("c_seq").alias("seq"), _key("set_id", "uri", "local").alias("base"))
    joined_ = spelled.unionByName(inline.where("construct = 'union'").select("set_id", "file", F.col("c_seq").alias("seq"), F.col("inner").alias("base")))
    members = joined_.join(boxes.select("set_id", "file", "seq", "key"), ["set_id", "file", "seq"]).select(F.col("key").alias("type_ref"), "base")
    ways = bases.select("type_ref", "base").unionByName(members).distinct().persist()
    closed = grown(types.select(F.col("type_ref").alias("owner"), F.col("type_ref").alias("from")), lambda f: f.join(ways, F.col("from") == F.col("type_ref")).select("owner", F.col("base").alias("from")), ["owner", "from"])
    unions = closed.where(~F.col("from").contains("|")).select(F.col("owner").alias("type_ref"), F.col("from").alias("member")).distinct()
    limits = own.where(F.col("construct").isin(*FACETS) & F.col("a_value").isNotNull() & F.col("c_seq").isNotNull()).select("file", "c_seq", "construct", "a_value").join(keyed, ["file", "c_seq"]).select(F.col("owner").alias("from"), F.col("construct").alias("facet"), F.col("a_value").alias("limit"))
    chain = ancestors.select("owner", "from", "distance").join(limits, "from")
    facets = chain.where("facet <> 'enumeration'").groupBy("owner", "from", "facet").agg(F.array_join(F.array_sort(F.collect_set("limit")), "|").alias("limit")).select(F.col("owner").alias("type_ref"), "facet", "limit").distinct()
    lists = chain.where("facet = 'enumeration'")
    nearest_list = lists.groupBy("owner").agg(F.min("distance").alias("distance"))
    values = lists.join(nearest_list, ["owner", "distance"]).select(F.col("owner").alias("type_ref"), F.col("limit").alias("value")).distinct()
    unions, facets, values = (stored(x)[0] for x in (unions, facets, values))
    alternatives = elements.sparkSession.createDataFrame([], _ALTERNATIVES)
    if members.where(F.col("base").contains("|")).limit(1).count():
        alternatives = stored(_alternatives(ancestors, bases, members.distinct(), unions, facets, values))[0]
    return SchemaSets(files, types, stored(declarations)[0], stored(follows)[0], stored(attributes_)[0], unions, facets, values, alternatives)
