"""Quality checks of vocabularies: anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import is_valid_local_name
from .graphs import TYPE

PROVENANCE = ("source_document", "source_version", "source_section", "ingestion_timestamp")


def missing_annotation(triples: DataFrame, cls: str, predicate: str) -> DataFrame:
    """LNT1: ``graph_id, s``: subjects of a class that have no such predicate (blank values count as none)."""
    have = triples.where((F.col("p") == predicate) & (F.trim("o") != "")).select("graph_id", "s").distinct()
    return triples.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("graph_id", "s").distinct().join(have, ["graph_id", "s"], "left_anti")


def missing_terms(triples: DataFrame, expected: DataFrame) -> DataFrame:
    """LNT2: ``term, cls`` of the list that the merged graphs don't declare."""
    have = triples.where(F.col("p") == TYPE).select(F.col("s").alias("term"), F.col("o").alias("cls")).distinct()
    return expected.select("term", "cls").distinct().join(have, ["term", "cls"], "left_anti")


def foreign_terms(triples: DataFrame, classes: list[str], ns: str) -> DataFrame:
    """LNT3: declared terms outside the namespace, or whose local name is not valid there."""
    own = triples.where((F.col("p") == TYPE) & F.col("o").isin(*classes)).select("graph_id", "s").distinct()
    inside = F.col("s").startswith(ns)
    reason = F.when(~inside, "foreign-namespace").when(~is_valid_local_name(F.expr(f"substring(s, {len(ns) + 1})")), "invalid-local-name")
    return own.withColumn("reason", reason).where("reason is not null")


def single_declaration(triples: DataFrame, cls: str, expected: str | None = None) -> DataFrame:
    """LNT4: one row ``n_declared, first_iri, last_iri, ok`` over the merged graph. Names are counted and compared, never gathered: where
    there are several, the first and the last in order stand for them, and ``declared`` has all of them as rows."""
    names = declared(triples, cls)
    out = names.agg(F.count("s").alias("n_declared"), F.min("s").alias("first_iri"), F.max("s").alias("last_iri"))
    right = F.lit(True) if expected is None else F.coalesce(F.col("first_iri") == expected, F.lit(False))
    return out.withColumn("ok", (F.col("n_declared") == 1) & right)


def declared(triples: DataFrame, cls: str) -> DataFrame:
    """``s``: each subject of a class once, whatever its graphs."""
    return triples.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("s").distinct()


def missing_provenance(rows: DataFrame, kind: str = "resource_type", provenance: str = "provenance") -> tuple[DataFrame, DataFrame]:
    """LNT5: (rows that lack a part of their provenance, with the parts; share with all parts per type)."""
    gone = F.filter(F.array(*[F.when(F.col(f"{provenance}.{p}").isNull(), p) for p in PROVENANCE]), lambda x: x.isNotNull())
    marked = rows.withColumn("missing", gone)
    share = marked.groupBy(kind).agg(F.avg(F.when(F.size("missing") == 0, 1.0).otherwise(0.0)).alias("full_share"), F.count(F.lit(1)).alias("n"))
    return marked.where(F.size("missing") > 0), share
