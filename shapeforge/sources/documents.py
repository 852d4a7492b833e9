"""Sources and sinks: packages, schema files, triples; reports and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_NAME = "uploaded-package.xml"
DEFAULT_SCOPE = "both"


def base_name(path: Column) -> Column:
    """Last part of a path, with either kind of slash."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)\z", 1)


def package_name(path: Column) -> Column:
    name = F.trim(base_name(path))
    return F.when(F.length(name) > 0, name).otherwise(F.lit(DEFAULT_NAME))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: every file as ``doc_id`` (its path), ``package_name``, ``content``. Files are dealt over tasks by size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), package_name(F.col("path")).alias("package_name"), "content")


def read_schema_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC2: ``file, text`` of the ``.xsd`` files (any case) directly in a folder, in order of lower-cased name."""
    files = spark.read.format("binaryFile").load(folder).where(F.lower("path").endswith(".xsd"))
    out = files.select(base_name(F.url_decode("path")).alias("file"), F.decode("content", "UTF-8").alias("text"))
    return out.orderBy(F.lower("file"), "file")


def packages_from_table(df: DataFrame, id_col: str, text_col: str, name_col: str | None = None, scope_col: str | None = None) -> DataFrame:
    """SRC3: package requests from a table; blank names and missing scopes get their defaults."""
    name = package_name(F.col(name_col)) if name_col else F.lit(DEFAULT_NAME)
    scope = F.coalesce(F.col(scope_col), F.lit(DEFAULT_SCOPE)) if scope_col else F.lit(DEFAULT_SCOPE)
    return df.select(F.col(id_col).cast("string").alias("doc_id"), name.alias("package_name"), F.col(text_col).alias("xml_text"), scope.alias("investor_scope"))


_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:(<[^>]*>|_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'


def _unescaped(c: Column) -> Column:
    mark = "﷐"
    out = F.replace(c, F.lit("\\\\"), F.lit(mark))
    for code, plain in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.replace(out, F.lit(mark), F.lit("\\"))


def _node(c: Column, graph: Column) -> Column:
    """IRIs without brackets; blank nodes named by their graph, so they are never equal across graphs."""
    return F.when(c.startswith("_:"), F.concat(F.lit("urn:bnode:"), graph, F.lit(":"), F.substring(c, 3, 1 << 20))).otherwise(F.regexp_extract(c, "^<(.*)>$", 1))


def parse_ntriples(lines: DataFrame, line_col: str = "value", graph_col: str = "graph_id") -> DataFrame:
    """Triples of N-Triples lines; lines that are no statement (comments, blanks) are left out."""
    part = lambda i: F.regexp_extract(F.col(line_col), _LINE, i)
    rows = lines.where(F.col(line_col).rlike(_LINE))
    node = part(3)
    is_node = F.length(node) > 0
    kind = F.when(is_node & node.startswith("_:"), "bnode").when(is_node, "iri").otherwise("literal")
    graph = F.col(graph_col)
    return rows.select(
        graph.alias("graph_id"), _node(part(1), graph).alias("s"), part(2).alias("p"),
        F.when(is_node, _node(node, graph)).otherwise(_unescaped(part(4))).alias("o"), kind.alias("o_kind"),
        F.nullif(part(5), F.lit("")).alias("o_datatype"), F.nullif(part(6), F.lit("")).alias("o_lang"),
    )


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: N-Triples files as one set of triples per file; ``graph_id`` is the file's stem."""
    lines = spark.read.text(path).withColumn("graph_id", F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/\\]*?)(?:\.[^./\\]*)?\z", 1))
    return parse_ntriples(lines).dropDuplicates()


def ntriples(s: Column, p: Column, o: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    """One N-Triples statement."""
    text = o
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    suffix = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise("")
    obj = F.when(kind == "literal", F.concat(F.lit('"'), text, F.lit('"'), suffix)).otherwise(F.concat(F.lit("<"), o, F.lit(">")))
    return F.concat(F.lit("<"), s, F.lit("> <"), p, F.lit("> "), obj, F.lit(" ."))


def triple_lines(triples: DataFrame) -> DataFrame:
    """``value``: the N-Triples text of each triple."""
    return triples.select(ntriples(*[F.col(c) for c in ("s", "p", "o", "o_kind", "o_datatype", "o_lang")]).alias("value"))


#: Triples of a file of ``write_triples``, about.
FILE_ROWS = 4_000_000


def clustered_triples(triples: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """``triples`` in ranges of (predicate, graph) of about ``file_rows``: a predicate that holds more is spread over ranges of its graphs
    (by sampled bounds), and those that hold few share a task, so a folder per predicate gets few files, all of useful size."""
    n = max(1, -(-triples.count() // file_rows))
    return triples.repartitionByRange(n, "p", "graph_id").sortWithinPartitions("p", "graph_id", "s")


def write_triples(triples: DataFrame, path: str, form: str = "ntriples", file_rows: int = FILE_ROWS) -> None:
    """SNK1: N-Triples text, or Parquet in one folder per predicate (few predicates hold most triples), clustered before."""
    if form == "ntriples":
        triple_lines(triples).write.mode("overwrite").text(path)
    else:
        clustered_triples(triples, file_rows).write.mode("overwrite").partitionBy("p").parquet(path)


def nested_reports(reports: DataFrame, findings: DataFrame, limit: int | None = None) -> DataFrame:
    """One record per report with its findings in order of place; ``limit`` bounds the findings embedded in a record
    (the counts beside them stay whole)."""
    fields = ["severity", "message", "line", "col", "error_code", "data_location"]
    order = F.struct(F.coalesce("line", F.lit(0)).alias("l"), F.coalesce("col", F.lit(0)).alias("c"), *[F.col(f) for f in fields])
    per = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("all"))
    kept = F.col("all") if limit is None else F.slice("all", 1, limit)
    per = per.select("doc_id", F.transform(kept, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("findings"))
    empty = F.array().cast(dict(per.dtypes)["findings"])
    return reports.join(per, "doc_id", "left").withColumn("findings", F.coalesce("findings", empty))


def write_reports(reports: DataFrame, findings: DataFrame, path: str, form: str = "json", limit: int | None = None) -> None:
    """SNK2: one nested record per document."""
    nested_reports(reports, findings, limit).write.mode("overwrite").format(form).save(path)


def profile_texts(profile: DataFrame) -> DataFrame:
    """``file, value``: a deterministic text per schema file from ``file, line_number, prefix, attributes, constructs``."""
    head = [F.concat(F.lit("File: "), "file"), F.concat(F.lit("Header line: "), F.col("line_number").cast("string")), F.concat(F.lit("Prefix: "), "prefix"), F.lit("Attributes:")]
    attrs = F.transform("attributes", lambda a: F.concat(F.lit("  "), a["name"], F.lit('="'), a["value"], F.lit('"')))
    parts = F.transform("constructs", lambda c: F.concat(F.lit("  "), c))
    return profile.select("file", F.array_join(F.concat(F.array(*head), attrs, F.array(F.lit("Constructs:")), parts), "\n").alias("value"))


def write_component_profiles(profile: DataFrame, path: str) -> None:
    """SNK3: one text per schema file, in a folder of its own; files are never merged."""
    profile_texts(profile).write.mode("overwrite").partitionBy("file").text(path)
