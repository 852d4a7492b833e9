"""Structural conformance of element tables, as joins with schema tables.

Elements are typed once, by a join on the path without indexes: the distinct paths that occur are typed level by level, so types
may recurse and no plan grows with the depth (or, where a depth is given, the declarations are expanded to that depth). All
checks start from that typed table. A finding has the place, the governing component, the observed and the expected value.

Declarations: ``owner`` (type name, or ``#root``), ``name``, ``type_ref``, ``pos``, ``min_occurs`` (default 1),
``max_occurs`` (null: unbounded), ``fixed``, ``choice_id``, ``branch``; ``resolve.schema_sets`` derives them from schema files.
Where declarations have a ``set_id``, elements need one too and are typed by their own set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import ancestor_paths, compared, normalize_path, strip
from ..schemas import XSI_NS
from .fixpoint import grown, stored

ROOT = "#root"
#: A table of schema paths is broadcast up to so many rows.
SMALL = 100_000


def _pinned(df: DataFrame) -> DataFrame:
    """``df`` persisted, and broadcast where its count is small. Declarations themselves come with a known size, so Spark
    decides on them by its own threshold."""
    df = df.persist()
    return F.broadcast(df) if df.count() <= SMALL else df


def schema_paths(declarations: DataFrame, max_depth: int) -> DataFrame:
    """``schema_path, type_ref, owner, name``: declarations by where they may stand."""
    decl = declarations.select("owner", "name", "type_ref")
    level = decl.where(F.col("owner") == ROOT).select(F.concat(F.lit("/"), "name").alias("schema_path"), "type_ref", "owner", "name")
    out = level
    for _ in range(max_depth):
        level = level.select("schema_path", F.col("type_ref").alias("owner")).join(F.broadcast(decl), "owner").select(F.concat("schema_path", F.lit("/"), "name").alias("schema_path"), "type_ref", "owner", "name")
        out = out.unionByName(level)
    return out.dropDuplicates(["schema_path"])


def occurring_paths(elements: DataFrame, declarations: DataFrame) -> DataFrame:
    """``set_id, schema_path, type_ref``: the paths of ``elements`` that are declared. A path is typed from its parent's type, so each
    round types one more level, of paths that occur only."""
    both = lambda df: df if "set_id" in df.columns else df.withColumn("set_id", F.lit(""))
    bare = F.regexp_replace("path", r"\[\d+\]", "")
    trie, _ = stored(both(elements).select("set_id", bare.alias("schema_path"), F.col("local_name").alias("name")).distinct().withColumn("up", F.regexp_replace("schema_path", r"/[^/]*\z", "")))
    decl = both(declarations).select("set_id", "owner", "name", "type_ref").dropDuplicates(["set_id", "owner", "name"]).persist()
    roots = trie.where("up = ''").join(decl.where(F.col("owner") == ROOT), ["set_id", "name"]).select("set_id", "schema_path", "type_ref")

    def below(front: DataFrame) -> DataFrame:
        rows = front.select("set_id", F.col("schema_path").alias("up"), F.col("type_ref").alias("owner")).join(trie, ["set_id", "up"])
        return rows.join(decl, ["set_id", "owner", "name"]).select("set_id", "schema_path", "type_ref")

    found = grown(roots, below, ["set_id", "schema_path"])
    decl.unpersist()
    return found


def typed_elements(elements: DataFrame, declarations: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``elements`` with ``type_ref`` (null: not declared there) and ``parent_type`` (``#root`` above the root). With ``max_depth`` the
    declarations are expanded to it, which saves the rounds where documents are flat; else see ``occurring_paths``."""
    by = ["set_id"] if "set_id" in declarations.columns else []
    paths = occurring_paths(elements, declarations) if max_depth is None or by else schema_paths(declarations, max_depth)
    paths = _pinned(paths.select(*by, "schema_path", "type_ref", F.lit(True).alias("declared")))
    bare = F.col("bare_path") if "bare_path" in elements.columns else F.regexp_replace("path", r"\[\d+\]", "")
    out = elements.withColumn("schema_path", bare).join(paths, [*by, "schema_path"], "left")
    up = paths.select(*by, F.col("schema_path").alias("up"), F.col("type_ref").alias("parent_type"), F.lit(True).alias("up_declared"))
    above = F.left("schema_path", F.char_length("schema_path") - F.char_length(F.substring_index("schema_path", "/", -1)) - 1)
    out = out.withColumn("up", above).join(up, [*by, "up"], "left")
    return out.drop("up", "bare_path").withColumn("parent_type", F.when(F.col("depth") == 0, ROOT).otherwise(F.col("parent_type")))


def finding(code: str, message: Column, component: Column, observed: Column, expected: Column, path: Column | str = "path") -> list[Column]:
    col = F.col(path) if isinstance(path, str) else path
    return [F.col("doc_id"), F.lit("error").alias("severity"), F.lit(code).alias("error_code"), col.alias("data_location"), component.alias("component"), observed.alias("observed_value"), expected.alias("expected_condition"), message.alias("message")]


def unknown_elements(typed: DataFrame, wildcards: DataFrame | None = None) -> DataFrame:
    """CON1: elements that their parent's type doesn't declare, unless it is one of ``wildcards`` (``owner``). What stands below an
    unknown element is not reported."""
    if wildcards is not None:
        typed = typed.join(wildcards.select(F.col("owner").alias("parent_type")), "parent_type", "left_anti")
    bad = typed.where(F.col("declared").isNull() & ((F.col("depth") == 0) | F.col("up_declared").isNotNull()))
    return bad.select(*finding("unknown-element", F.concat(F.lit("Unexpected element "), "local_name"), F.col("parent_type"), F.col("local_name"), F.lit("a declared child")))


def _n_of(name: Column) -> Column:
    """How often an element's children have a name."""
    return F.aggregate(F.filter("children", lambda c: c["name"] == name), F.lit(0), lambda n, c: n + c["n"])


def missing_elements(typed: DataFrame, declarations: DataFrame) -> DataFrame:
    """CON2: required children that are absent; the place is the parent, the only one the document has. What a name needs at several
    places of a type adds up. Children are counted where the document is parsed, so a parent is judged by its own row."""
    need = declarations.where((F.coalesce("min_occurs", F.lit(1)) > 0) & (F.col("owner") != ROOT) & F.col("choice_id").isNull()).groupBy(F.col("owner").alias("type_ref"), "name").agg(F.sum(F.coalesce("min_occurs", F.lit(1))).cast("int").alias("least"))
    # a lookup for each need, rather than functions over lists, which run uncompiled
    kids = typed.where("declared").select("doc_id", "path", "type_ref", F.map_from_entries("children").alias("kids"))
    got = kids.join(need, "type_ref").withColumn("n", F.coalesce(F.col("kids")[F.col("name")], F.lit(0))).where("n < least")
    return got.select(*finding("missing-element", F.concat(F.lit("Missing element "), "name"), F.col("type_ref"), F.col("n").cast("string"), F.concat(F.lit("at least "), F.col("least").cast("string"), F.lit(" "), F.col("name"))))


def too_many_elements(typed: DataFrame, declarations: DataFrame) -> DataFrame:
    """CON3: children that stand more often than allowed at all places of their name together; one finding per parent and name."""
    most = declarations.groupBy("owner", "name").agg(F.when(F.count("max_occurs") == F.count(F.lit(1)), F.sum("max_occurs")).cast("int").alias("most")).where("most is not null")
    most = most.select(F.col("owner").alias("parent_type"), F.col("name").alias("local_name"), "most")
    # a document's root is the one child of the place above it
    parent = lambda *cols: F.struct(*[c.alias(n) for n, c in zip(("parent_type", "parent_path", "kids"), cols, strict=True)])
    parents = F.array(
        parent(F.col("type_ref"), F.col("path"), F.map_from_entries("children")),
        F.when(F.col("depth") == 0, parent(F.lit(ROOT), F.lit(""), F.create_map(F.col("local_name"), F.lit(1)))),
    )
    rows = typed.where("declared").select("doc_id", F.explode(parents).alias("x")).where("x is not null").select("doc_id", "x.*").join(most, "parent_type")
    over = rows.withColumn("n", F.col("kids")[F.col("local_name")]).where("n > most")
    return over.select(*finding("too-many-elements", F.concat(F.lit("Too many elements "), "local_name"), F.col("parent_type"), F.col("n").cast("string"), F.concat(F.lit("at most "), F.col("most").cast("string")), "parent_path"))


def order_violations(typed: DataFrame, declarations: DataFrame) -> DataFrame:
    """CON4: a child that stands anywhere behind a sibling which the sequence puts after it; the members of a choice have the
    choice's place. The sibling named is the last-placed one before it."""
    pos = declarations.select(F.col("owner").alias("parent_type"), F.col("name").alias("local_name"), "pos")
    rows = typed.where("declared and depth > 0").select("doc_id", "parent_seq", "seq", "parent_type", "local_name", "path").join(pos, ["parent_type", "local_name"])
    w = Window.partitionBy("doc_id", "parent_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("top", F.max(F.struct("pos", "local_name")).over(w)).where("top.pos > pos").withColumn("before_name", F.col("top.local_name"))
    return rows.select(*finding("order", F.concat(F.lit("Element out of order: "), "local_name"), F.col("parent_type"), F.concat("local_name", F.lit(" after "), "before_name"), F.concat("local_name", F.lit(" before "), "before_name")))


def choice_violations(typed: DataFrame, declarations: DataFrame) -> DataFrame:
    """CON5: more than one branch of a choice, or none of a required one (one whose branches all have min_occurs > 0). A name that
    stands elsewhere in the type too may be there for that, so it is no second branch (CON4 judges its place)."""
    places = declarations.groupBy(F.col("owner").alias("type_ref"), "name").agg((F.count(F.lit(1)) > 1).alias("elsewhere"))
    branch = declarations.where(F.col("choice_id").isNotNull()).select(F.col("owner").alias("type_ref"), "name", "choice_id", "branch", F.coalesce("min_occurs", F.lit(1)).alias("least")).join(places, ["type_ref", "name"])
    choices = branch.groupBy("type_ref", "choice_id").agg((F.min("least") > 0).alias("required"), F.collect_list(F.struct("branch", "name", "elsewhere")).alias("branches"))
    used = lambda ok: F.size(F.array_distinct(F.transform(F.filter("branches", lambda b: b["branch"].isNotNull() & ok(b) & (_n_of(b["name"]) > 0)), lambda b: b["branch"])))
    parents = typed.where("declared").select("doc_id", "path", "type_ref", "children").join(choices, "type_ref")
    rows = parents.select("doc_id", "path", "type_ref", "choice_id", "required", used(lambda b: F.lit(True)).alias("met"), used(lambda b: ~b["elsewhere"]).alias("n")).where("n > 1 or (met = 0 and required)")
    return rows.select(*finding("choice", F.concat(F.lit("Choice "), "choice_id"), F.col("type_ref"), F.col("n").cast("string"), F.lit("exactly one branch")))


def sequence_violations(typed: DataFrame, follows: DataFrame) -> DataFrame:
    """CON4, CON5: children next to each other that their parent's content model doesn't let follow each other (``follows``: ``owner,
    before, after``, with ``^`` before the first and ``$`` behind the last child).

    Sequences, choices and loops of any nesting are judged: A B A passes where the choice of A and B may repeat and fails in a
    sequence of both. Counts are those of CON2 and CON3. Children that are not declared are passed over (CON1 names them), and so
    are parents with a wildcard. The place is the second child's, or the parent's where the last child may not be the last.
    """
    models = follows.where("before <> '^' or after <> '$'").groupBy("owner").agg(F.max((F.col("before") == "*") | (F.col("after") == "*")).alias("wild")).where("not wild").select(F.col("owner").alias("parent_type"))
    kids = typed.where("declared and depth > 0").select("doc_id", "parent_path", "parent_type", "local_name", "path", "seq").join(models, "parent_type", "left_semi")
    w = Window.partitionBy("doc_id", "parent_path").orderBy("seq")
    kids = kids.withColumn("before", F.coalesce(F.lag("local_name").over(w), F.lit("^"))).withColumn("last", F.lead("seq").over(w).isNull())
    steps = F.array(F.struct("before", F.col("local_name").alias("after"), F.col("path").alias("at")), F.when(F.col("last"), F.struct(F.col("local_name").alias("before"), F.lit("$").alias("after"), F.col("parent_path").alias("at"))))
    steps = kids.select("doc_id", "parent_type", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("x")).select("doc_id", F.col("parent_type").alias("owner"), "x.*")
    bad = steps.join(follows.select("owner", "before", "after").distinct(), ["owner", "before", "after"], "left_anti")
    name = lambda c: F.when(F.col(c) == "^", "the start").when(F.col(c) == "$", "the end").otherwise(F.col(c))
    observed = F.concat(name("after"), F.lit(" after "), name("before"))
    return bad.select(*finding("content-model", F.concat(F.lit("Not allowed here: "), observed), F.col("owner"), observed, F.concat(F.lit("a child that may follow "), name("before")), "at"))


def attribute_violations(typed: DataFrame, attributes: DataFrame, declared: DataFrame) -> DataFrame:
    """CON6: required attributes that are missing, attributes that are not declared (``owner, name, use``).

    Attributes of a namespace (links, schema locations) are not judged here.
    """
    els = typed.where("declared").select("doc_id", "seq", "path", "type_ref")
    have = attributes.where(F.col("ns").isNull()).select("doc_id", "seq", "name", "value")
    need = declared.where("use = 'required'").select(F.col("owner").alias("type_ref"), "name")
    missing = els.join(need, "type_ref").join(have, ["doc_id", "seq", "name"], "left_anti")
    known = declared.select(F.col("owner").alias("type_ref"), "name")
    extra = els.join(have, ["doc_id", "seq"]).join(known, ["type_ref", "name"], "left_anti")
    a = missing.select(*finding("missing-attribute", F.concat(F.lit("Missing attribute "), "name"), F.col("type_ref"), F.lit(""), F.concat(F.lit("attribute "), "name")))
    b = extra.select(*finding("unknown-attribute", F.concat(F.lit("Unexpected attribute "), "name"), F.col("type_ref"), F.col("value"), F.lit("a declared attribute")))
    return a.unionByName(b)


#: Lexical forms, anchored; digits are ASCII.
_DECIMAL = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
_INTEGER = r"[+-]?[0-9]+"
_ZONE = r"(?:Z|[+-](?:0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)"
_TIME = r"(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?|24:00:00(?:\.0+)?)"


def _cases(of: Column, cases: list[tuple], names, other: Column) -> Column:
    """The value of the case that ``of`` names, else ``other``. Cases of no name among ``names`` (None: any) are left out, so the code
    of a pass stays short."""
    out = F
    for wanted, value in cases:
        wanted = [x for x in wanted if names is None or x in names]
        if wanted:
            out = out.when(of.isin(*wanted), value)
    return other if out is F else out.otherwise(other)


def is_lexical(kind: Column, value: Column, kinds=None) -> Column:
    """Whether ``value`` is in the lexical space of the built-in or domain type ``kind``; unknown types accept anything.

    Patterns come first and casts after: casts trim and round. Calendar dates must exist. ``kinds``: all names that ``kind`` may
    have, where they are known.
    """
    full = lambda p: value.rlike(rf"\A(?:{p})\z")
    as_int = value.try_cast("bigint")
    wide = value.try_cast("decimal(38,0)")
    whole = lambda low=None, high=None: full(_INTEGER) & (F.lit(True) if low is None else wide >= F.lit(low)) & (F.lit(True) if high is None else F.coalesce(wide <= F.lit(high), F.lit(False)))
    day = F.substring(value, 1, 10).try_cast("date").isNotNull()
    year, month = full("[0-9]{4}"), full("[0-9]{4}-(?:0[1-9]|1[0-2])")
    date = full(r"[0-9]{4}-[0-9]{2}-[0-9]{2}") & day
    cases = [
        (("Amount", "Percent", "Rate", "Numeric", "decimal"), full(_DECIMAL)),
        (("Count",), full(_INTEGER) & (as_int >= 0) & (as_int <= 2147483647)),
        (("SequenceNumber",), full(_INTEGER) & (as_int >= 1) & (as_int <= 2147483647)),
        (("Year",), full(_INTEGER) & as_int.between(1, 9999)),
        (("integer",), full(_INTEGER)),
        (("nonNegativeInteger",), full(r"\+?[0-9]+|-0+")),
        (("positiveInteger",), full(r"\+?0*[1-9][0-9]*")),
        (("nonPositiveInteger",), full(r"-[0-9]+|\+?0+")),
        (("negativeInteger",), full(r"-0*[1-9][0-9]*")),
        (("byte",), whole(-(1 << 7), (1 << 7) - 1)),
        (("short",), whole(-(1 << 15), (1 << 15) - 1)),
        (("int",), whole(-(1 << 31), (1 << 31) - 1)),
        (("long",), full(_INTEGER) & as_int.isNotNull()),
        (("unsignedByte", "unsignedShort", "unsignedInt"), whole(0, (1 << 32) - 1)),
        (("double", "float"), full(rf"(?:{_DECIMAL})(?:[eE][+-]?[0-9]+)?|-?INF|NaN")),
        (("gYear",), full(rf"-?[0-9]{{4,}}{_ZONE}?")),
        (("gYearMonth",), full(rf"-?[0-9]{{4,}}-(?:0[1-9]|1[0-2]){_ZONE}?")),
        (("gMonthDay",), full(rf"--(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]){_ZONE}?")),
        (("NMTOKEN", "NMTOKENS"), full(r"[\w.:-]+" + r"(?: [\w.:-]+)*")),
        (("NCName", "ID", "IDREF", "ENTITY"), full(r"[A-Za-z_\u00C0-\uFFFD][\w.\u00B7-\uFFFD-]*")),
        (("language",), full("[a-zA-Z]{1,8}(?:-[a-zA-Z0-9]{1,8})*")),
        (("hexBinary",), full("(?:[0-9a-fA-F]{2})*")),
        (("Date",), year | month | date),
        (("date",), full(rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{_ZONE}?") & day),
        (("Datetime",), full(rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_TIME}{_ZONE}") & full(r"[^.]*(?:\.[0-9]{1,9}(?![0-9]).*)?") & day),
        (("dateTime",), full(rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_TIME}{_ZONE}?") & day),
        (("Indicator",), value.isin("true", "false")),
        (("boolean",), value.isin("true", "false", "1", "0")),
        (("NumericString",), full("[0-9]*")),
        (("Day", "gDay"), full(rf"---(?:0[1-9]|[12][0-9]|3[01]){_ZONE}?")),
        (("Month", "gMonth"), full(rf"--(?:0[1-9]|1[0-2]){_ZONE}?")),
        (("Time", "time"), full(rf"{_TIME}{_ZONE}?")),
        (("URI", "anyURI"), ~value.rlike(r"[\s<>\"{}|\\^`]")),
        (("Enum", "Code"), F.char_length(value) <= 80),
        (("String", "Identifier", "Value"), F.char_length(value) <= 16383),
    ]
    return _cases(kind, cases, kinds, F.lit(True))


def simple_values(typed: DataFrame) -> DataFrame:
    """Declared elements without children: those whose text is a value."""
    return typed.where("declared and n_children = 0").withColumn("value", F.coalesce("text", F.lit("")))


def values_with_attributes(typed: DataFrame, attributes: DataFrame, declared: DataFrame) -> DataFrame:
    """One table of values for the checks of datatypes, facets, lists and fixed values: the declared elements and, as ``@name`` of their
    element's type, the declared attributes (``owner, name, type_ref``) that have no namespace."""
    cols = ("doc_id", "path", "local_name", "parent_type", "type_ref", "declared", "n_children", "text")
    own = typed.where("declared").select("doc_id", "seq", "path", F.col("type_ref").alias("owner"))
    have = attributes.where(F.col("ns").isNull()).select("doc_id", "seq", "name", F.col("value").alias("text"))
    rows = own.join(have, ["doc_id", "seq"]).join(declared.select("owner", "name", "type_ref"), ["owner", "name"])
    rows = rows.select("doc_id", F.concat("path", F.lit("/@"), "name").alias("path"), F.concat(F.lit("@"), "name").alias("local_name"), F.col("owner").alias("parent_type"), "type_ref", F.lit(True).alias("declared"), F.lit(0).alias("n_children"), "text")
    return typed.where("declared").select(*cols).unionByName(rows)


def fixed_with_attributes(declarations: DataFrame, declared: DataFrame) -> DataFrame:
    """``owner, name, fixed`` of elements and, as ``@name``, of attributes."""
    return declarations.select("owner", "name", "fixed").unionByName(declared.select("owner", F.concat(F.lit("@"), "name").alias("name"), "fixed"))


def datatype_violations(typed: DataFrame, unions: DataFrame | None = None, kinds=None) -> DataFrame:
    """CON7: values outside the lexical space of their type; with ``unions(type_ref, member)`` any member will do. ``kinds``: all types
    and members there are, where they are known."""
    rows = simple_values(typed)
    if unions is not None:
        members = unions.groupBy("type_ref").agg(F.collect_set("member").alias("members"))
        rows = rows.join(members, "type_ref", "left")
        good = F.when(F.col("members").isNull(), is_lexical(F.col("type_ref"), F.col("value"), kinds)).otherwise(F.exists("members", lambda m: is_lexical(m, F.col("value"), kinds)))
    else:
        good = is_lexical(F.col("type_ref"), F.col("value"), kinds)
    return rows.where(~good).select(*finding("datatype", F.concat(F.lit("Not a valid "), "type_ref"), F.col("type_ref"), F.col("value"), F.col("type_ref")))


def breaks_facet(facet: Column, limit: Column, v: Column, names=None) -> Column:
    """Whether the value ``v`` is outside a facet's limit; null for facets that don't limit values. ``names``: all that ``facet`` may
    be, where they are known."""
    fraction = F.length(F.regexp_extract(v, r"\.([0-9]*)\z", 1))
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    cases = [
        (("maxLength",), F.char_length(v) > limit.try_cast("int")),
        (("minLength",), F.char_length(v) < limit.try_cast("int")),
        (("length",), F.char_length(v) != limit.try_cast("int")),
        (("minInclusive",), F.coalesce(compared(v, limit) < 0, F.lit(False))),
        (("maxInclusive",), F.coalesce(compared(v, limit) > 0, F.lit(False))),
        (("minExclusive",), F.coalesce(compared(v, limit) <= 0, F.lit(False))),
        (("maxExclusive",), F.coalesce(compared(v, limit) >= 0, F.lit(False))),
        (("fractionDigits",), fraction > limit.try_cast("int")),
        (("totalDigits",), digits > limit.try_cast("int")),
        (("pattern",), ~F.regexp_like(v, F.concat(F.lit(r"\A(?:"), limit, F.lit(r")\z")))),
    ]
    return _cases(facet, cases, names, F.lit(None).cast("boolean"))


def facet_violations(typed: DataFrame, facets: DataFrame, names=None) -> DataFrame:
    """CON8: one finding per failing facet (``type_ref, facet, limit``)."""
    rows = simple_values(typed).join(facets, "type_ref")
    v, limit = F.col("value"), F.col("limit")
    bad = breaks_facet(F.col("facet"), limit, v, names)
    return rows.where(bad).select(*finding("facet", F.concat(F.lit("Facet "), "facet"), F.col("type_ref"), v, F.concat("facet", F.lit(" "), "limit")))


def union_violations(typed: DataFrame, alternatives: DataFrame) -> DataFrame:
    """CON7, CON8, CON9: values of a union that have the form of some member but meet the facets and the list of none
    (``type_ref, alternatives``, see ``resolve.schema_sets``). Values without the form of any are those of ``datatype_violations``."""
    rows = simple_values(typed).join(alternatives, "type_ref")
    v = F.col("value")
    formed = lambda a: a["kind"].isNull() | is_lexical(a["kind"], v)
    meets = lambda a: formed(a) & (a["listed"].isNull() | F.array_contains(a["listed"], v)) & ~F.exists(a["facets"], lambda f: F.coalesce(breaks_facet(f["facet"], f["limit"], v), F.lit(False)))
    bad = rows.where(F.exists("alternatives", formed) & ~F.exists("alternatives", meets))
    return bad.select(*finding("union", F.lit("Value is none of the union's members"), F.col("type_ref"), v, F.concat(F.lit("a value of a member of "), "type_ref")))


def abstract_violations(typed: DataFrame, attributes: DataFrame, types: DataFrame) -> DataFrame:
    """Elements of an abstract type (``type_ref, abstract``) that name no other one by ``xsi:type``."""
    named = attributes.where((F.col("ns") == XSI_NS) & (F.col("name") == "type")).select("doc_id", "seq")
    rows = typed.where("declared").join(types.where("abstract").select("type_ref"), "type_ref").join(named, ["doc_id", "seq"], "left_anti")
    return rows.select(*finding("abstract-type", F.concat(F.lit("Abstract type of element "), "local_name"), F.col("type_ref"), F.col("local_name"), F.lit("a type that isn't abstract")))


def enumeration_violations(typed: DataFrame, enumerations: DataFrame) -> DataFrame:
    """CON9: raw values that are not in the controlled list (``type_ref, value``); blanks around a value fail."""
    listed = enumerations.select("type_ref").distinct()
    rows = simple_values(typed).join(listed, "type_ref", "left_semi").join(enumerations.select("type_ref", "value").distinct(), ["type_ref", "value"], "left_anti")
    return rows.select(*finding("enumeration", F.lit("Value is not in the controlled list"), F.col("type_ref"), F.col("value"), F.concat(F.lit("a value of "), "type_ref")))


def fixed_violations(typed: DataFrame, declarations: DataFrame) -> DataFrame:
    """CON10: raw values that differ from the fixed one; an empty element takes the fixed value."""
    fixed = declarations.where(F.col("fixed").isNotNull()).select(F.col("owner").alias("parent_type"), F.col("name").alias("local_name"), "fixed")
    rows = simple_values(typed).join(fixed, ["parent_type", "local_name"]).where("value <> fixed and value <> ''")
    return rows.select(*finding("fixed", F.lit("Value differs from the fixed value"), F.col("local_name"), F.col("value"), F.col("fixed")))


def repair_whitespace(typed: DataFrame, enumerations: DataFrame) -> DataFrame:
    """CON11: ``typed`` with ``repaired`` and ``text`` stripped where the raw value fails its list and the stripped one
    passes; the raw text stays in ``original_text``."""
    listed = enumerations.select("type_ref", F.col("value").alias("ok")).distinct()
    known = enumerations.select("type_ref", F.lit(True).alias("controlled")).distinct()
    rows = typed.withColumn("original_text", F.col("text")).withColumn("ok", strip(F.coalesce("text", F.lit("")))).join(known, "type_ref", "left")
    rows = rows.join(listed.withColumn("hit", F.lit(True)), ["type_ref", "ok"], "left")
    fix = F.col("controlled").isNotNull() & (F.col("n_children") == 0) & F.col("hit").isNotNull() & (F.col("text") != F.col("ok"))
    return rows.withColumn("repaired", F.coalesce(fix, F.lit(False))).withColumn("text", F.when(F.col("repaired"), F.col("ok")).otherwise(F.col("text"))).drop("ok", "hit", "controlled")


def locate_findings(findings: DataFrame, elements: DataFrame, location: str = "data_location") -> DataFrame:
    """CON12: ``line, col`` of the exact path, else of the nearest existing ancestor, else null.

    Findings are exploded to their ancestors, elements never are.
    """
    keyed = findings.withColumn("_norm", normalize_path(F.col(location)))
    ways = keyed.select("doc_id", "_norm").distinct().select("doc_id", "_norm", F.explode(ancestor_paths(F.col("_norm"))).alias("path"))
    found = ways.join(elements.select("doc_id", "path", "line", "col"), ["doc_id", "path"])
    best = found.groupBy("doc_id", "_norm").agg(F.max_by(F.struct("line", "col"), F.length("path")).alias("_at"))
    out = keyed.drop("line", "col").join(best, ["doc_id", "_norm"], "left")
    return out.withColumn("line", F.col("_at.line")).withColumn("col", F.col("_at.col")).drop("_at", "_norm")


def check_against(typed: DataFrame, attributes: DataFrame, schema) -> DataFrame:
    """All findings of CON1 to CON10 for documents typed by ``schema`` (``resolve.SchemaSets``), attributes' values included."""
    decl = schema.declarations.where("name <> '*'")
    values = values_with_attributes(typed, attributes, schema.attributes)
    found = [
        unknown_elements(typed, schema.wildcards), missing_elements(typed, decl), too_many_elements(typed, decl), sequence_violations(typed, schema.follows), choice_violations(typed, decl),
        attribute_violations(typed, attributes, schema.attributes), datatype_violations(values, schema.unions), facet_violations(values, schema.facets),
        union_violations(values, schema.alternatives), abstract_violations(typed, attributes, schema.types), enumeration_violations(values, schema.values), fixed_violations(values, fixed_with_attributes(decl, schema.attributes)),
    ]
    return reduce(DataFrame.unionByName, found)
