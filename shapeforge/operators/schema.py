"""Schema corpus: headers, construct profiles, components, includes, comparison, translation profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import documentation_text, local_name, strip
from ..schemas import XSD_NS

#: Fixed value: the first line of a schema file.
XML_DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>'
_SKIP = r"\A(?:\s|<!--[\s\S]*?-->)*"
_ATTRIBUTE = r"""([A-Za-z_][\w.:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def schema_headers(files: DataFrame) -> DataFrame:
    """SCH1: ``file, ok, error_code, line_number, prefix, schema_line, attributes[]`` of ``file, text``; no file is left out.

    Codes, in the order they are looked for: ``xml-declaration``, ``open-comment``, ``no-schema-element``,
    ``schema-prefix``, ``namespace-not-bound``, ``namespace-ambiguous``, ``prefix-mismatch``. The header is one line: a
    schema element that goes on behind it is judged by what stands on that line.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    first = F.substring_index(text, "\n", 1)
    rest = F.when(text.contains("\n"), F.substring(text, F.length(first) + 2, 1 << 30)).otherwise("")
    d = files.withColumn("_first", first).withColumn("_rest", rest)
    d = d.withColumn("_skip", F.regexp_extract("_rest", _SKIP, 0))
    d = d.withColumn("_line", strip(F.substring_index(F.substring(F.col("_rest"), F.length("_skip") + 1, F.lit(1 << 30)), "\n", 1)))
    d = d.withColumn("line_number", F.length("_skip") - F.length(F.replace(F.col("_skip"), F.lit("\n"))) + 2)
    d = d.withColumn("prefix", F.nullif(F.regexp_extract("_line", r"\A<(xsd|xs):schema(?=[\s>/]|\z)", 1), F.lit("")))
    bound = F.filter(
        F.array(*[F.when(F.col("_line").rlike(rf"""xmlns:{p}\s*=\s*["']{XSD_NS}["']"""), p) for p in ("xsd", "xs")]), lambda p: p.isNotNull()
    )
    d = d.withColumn("_bound", bound)
    code = (
        F.when(F.col("_first") != XML_DECLARATION, "xml-declaration")
        .when(F.col("_line").startswith("<!--"), "open-comment")
        .when(F.col("_line") == "", "no-schema-element")
        .when(F.col("prefix").isNull(), "schema-prefix")
        .when(F.size("_bound") == 0, "namespace-not-bound")
        .when(F.size("_bound") > 1, "namespace-ambiguous")
        .when(F.get("_bound", F.lit(0)) != F.col("prefix"), "prefix-mismatch")
    )
    d = d.withColumn("error_code", code)
    names = F.regexp_extract_all("_line", F.lit(_ATTRIBUTE), F.lit(1))
    twice = F.regexp_extract_all("_line", F.lit(_ATTRIBUTE), F.lit(2))
    once = F.regexp_extract_all("_line", F.lit(_ATTRIBUTE), F.lit(3))
    pairs = F.zip_with(names, F.zip_with(twice, once, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    good = F.col("error_code").isNull()
    return d.select(
        "file", good.alias("ok"), "error_code", F.when(good, F.col("line_number")).alias("line_number"), F.when(good, F.col("prefix")).alias("prefix"),
        F.when(good, F.col("_line")).alias("schema_line"), F.when(good, pairs).alias("attributes"),
    )


def component_profile(elements: DataFrame) -> DataFrame:
    """SCH2: ``file, constructs``: distinct schema constructs below the root, in case-insensitive order."""
    used = elements.where((F.col("ns") == XSD_NS) & (F.col("depth") > 0)).groupBy(F.col("doc_id").alias("file")).agg(F.collect_set("local_name").alias("c"))
    files = elements.select(F.col("doc_id").alias("file")).distinct()
    ordered = F.transform(F.array_sort(F.transform("c", lambda x: F.struct(F.lower(x).alias("k"), x.alias("x")))), lambda s: s["x"])
    return files.join(used, "file", "left").select("file", F.coalesce(ordered, F.array().cast("array<string>")).alias("constructs"))


_USED = ("name", "ref", "type", "base", "minOccurs", "maxOccurs", "use", "fixed", "value", "schemaLocation")
_NAMED = ("element", "attribute", "complexType", "simpleType", "group", "attributeGroup", "extension", "restriction", "include", "import")
_FACETS = ("maxLength", "minLength", "minInclusive", "maxInclusive", "fractionDigits", "totalDigits", "pattern", "enumeration", "whiteSpace", "length")


def wide_attributes(attributes: DataFrame) -> DataFrame:
    """One row per element with a column per attribute that schemas use; a fixed list, so no extra job for the pivot."""
    own = attributes.where(F.col("ns").isNull() & F.col("name").isin(*_USED))
    return own.groupBy("doc_id", "seq").pivot("name", list(_USED)).agg(F.first("value"))


def schema_components(elements: DataFrame, attributes: DataFrame) -> DataFrame:
    """SCH3: a row per named, referring or facet construct with type, base, occurrence, use, fixed, owner, documentation.

    Types and bases keep their prefixes, which tell built-in types from the schema's own. The owner is the nearest named ancestor's name (joined by path, not level by level); ``pos`` its order in the file.
    """
    own = elements.where(F.col("ns") == XSD_NS)
    rows = own.join(wide_attributes(attributes), ["doc_id", "seq"], "left")
    rows = rows.select("doc_id", "seq", "path", "parent_path", "local_name", *[F.col(f"`{a}`").alias(f"a_{a}") for a in _USED])
    named = rows.where(F.col("a_name").isNotNull()).select("doc_id", F.col("path").alias("np"), F.col("a_name").alias("owner"))
    kept = rows.where(F.col("local_name").isin(*_NAMED, *_FACETS))
    up = kept.select("doc_id", "seq", F.explode(F.expr("transform(sequence(1, greatest(size(split(parent_path, '/')) - 1, 1)), i -> concat_ws('/', slice(split(parent_path, '/'), 1, i + 1)))")).alias("np"))
    owner = up.join(named, ["doc_id", "np"]).groupBy("doc_id", "seq").agg(F.max_by("owner", F.length("np")).alias("owner"))
    docs = own.where("local_name = 'documentation'").select("doc_id", F.regexp_replace("parent_path", r"/annotation\[\d+\]\z", "").alias("path"), "seq", "text")
    docs = docs.groupBy("doc_id", "path").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("t")).select("doc_id", "path", documentation_text(F.col("t.text")).alias("doc"))
    out = kept.join(owner, ["doc_id", "seq"], "left").join(docs, ["doc_id", "path"], "left")
    occurs = F.when(F.col("a_maxOccurs") == "unbounded", None).otherwise(F.coalesce(F.col("a_maxOccurs").cast("int"), F.lit(1)))
    return out.select(
        F.col("doc_id").alias("file"), F.col("local_name").alias("construct"), F.coalesce("a_name", local_name(F.col("a_ref")), "a_value", "a_schemaLocation").alias("name"),
        F.col("a_type").alias("type_ref"), F.col("a_base").alias("base_ref"), "owner", F.col("seq").alias("pos"),
        F.coalesce(F.col("a_minOccurs").cast("int"), F.lit(1)).alias("min_occurs"), occurs.alias("max_occurs"), F.col("a_use").alias("use"), F.col("a_fixed").alias("fixed"), "doc",
    )


def resolve_schema_files(includes: DataFrame, root: str) -> DataFrame:
    """SCH4: ``file, depth, present`` for all files reachable from ``root`` over ``file, target``; missing targets have
    ``present`` false. Cycles end by themselves: a file keeps its least depth."""
    spark = includes.sparkSession
    reached, front, depth = {root: 0}, [root], 0
    while front:
        depth += 1
        level = spark.createDataFrame([(f,) for f in front], "file string")
        # names of one level of one schema, not rows of its files
        found = {r[0] for r in includes.join(level, "file").select("target").distinct().collect()}
        front = sorted(found - set(reached))
        reached |= dict.fromkeys(front, depth)
    reached = spark.createDataFrame(list(reached.items()), "file string, depth int")
    known = includes.select("file").distinct().withColumn("present", F.lit(True))
    return reached.join(known, "file", "left").select("file", "depth", F.coalesce("present", F.lit(False)).alias("present"))


def compare_schemas(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("construct", "owner", "name")) -> DataFrame:
    """SCH5: components that only one side has, or has more often: ``side, *keys, n``; empty iff the sets agree."""
    count = lambda d: d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    x, y = count(a).alias("x"), count(b).alias("y")
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    both = x.join(y, on, "full_outer").select(*[F.coalesce(F.col(f"x.{k}"), F.col(f"y.{k}")).alias(k) for k in keys], F.coalesce("x.n", F.lit(0)).alias("nx"), F.coalesce("y.n", F.lit(0)).alias("ny"))
    side = F.when(F.col("nx") > F.col("ny"), "first").when(F.col("ny") > F.col("nx"), "second")
    return both.select(side.alias("side"), *keys, F.abs(F.col("nx") - F.col("ny")).alias("n")).where("side is not null")


def construct_counts(components: DataFrame, schema_col: str, constructs: list[str]) -> DataFrame:
    """SCH5: constructs of each distribution side by side."""
    return components.groupBy(schema_col).pivot("construct", constructs).count().fillna(0)


def apply_translation_profile(components: DataFrame, rules: DataFrame) -> DataFrame:
    """SCH6: every component with its rule (``construct, becomes, needs_context, ordered``); without one it is flagged."""
    return components.join(rules, "construct", "left").withColumn("unmapped", F.col("becomes").isNull())
