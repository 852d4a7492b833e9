"""Registry of resources and rules, as tables with last-write-wins keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import mint_path_iri
from ..schemas import BASE


def upsert_latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """REG1: the last write of each key (partial aggregation: a hot key is no hot task). Full ties: the largest row."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest])).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """REG2: the rows of a batch of keys; unknown keys come back with ``found`` false."""
    return keys.select(key).distinct().join(df.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def find_schema_elements(resources: DataFrame, names: DataFrame, order: str = "insert_order", kind: str = "schema_element") -> DataFrame:
    """REG3: for each name the first resource of the kind with that label, in order of insertion."""
    asked = names.select(F.col("name").alias("label")).distinct()
    hits = resources.where(F.col("resource_type") == kind).join(asked, "label")
    best = hits.groupBy("label").agg(F.min(F.struct(order, "resource_id", "iri")).alias("r"))
    return asked.join(best, "label", "left").select(F.col("label").alias("name"), "r.resource_id", "r.iri")


def provenance(document: Column, version: Column, section: Column, at: Column) -> Column:
    return F.struct(document.alias("source_document"), version.alias("source_version"), section.alias("source_section"), at.alias("ingestion_timestamp"))


def ingest_resources(rows: DataFrame, origin: Column, kind: str = "kind", name: str = "name", base: str = BASE) -> DataFrame:
    """REG4: resources with id ``kind:name``, minted IRI, type, label and provenance; the time is given, never now()."""
    return rows.select(
        F.concat_ws(":", kind, name).alias("resource_id"), mint_path_iri(F.col(kind), F.col(name), base=base).alias("iri"),
        F.col(kind).alias("resource_type"), F.col(name).alias("label"), origin.alias("provenance"),
    )


def ingest_rules(rows: DataFrame, origin: Column, base: str = BASE) -> DataFrame:
    """REG5: rules with their defaults: severity error, applies to both, status active."""
    col = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in rows.columns else F.lit(d)
    none = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(
        "rule_id", mint_path_iri(F.lit("rule"), F.col("rule_id"), base=base).alias("iri"), col("title", "").alias("title"), col("rule_type", "schema").alias("rule_type"),
        col("severity", "error").alias("severity"), col("applies_to", "both").alias("applies_to"), none("description").alias("description"),
        none("source_expression").alias("source_expression"), col("status", "active").alias("status"), origin.alias("provenance"),
    )


def rule_catalogue(rules: DataFrame) -> DataFrame:
    """REG5: ids, source, investor and status."""
    return rules.select("rule_id", F.col("provenance.source_document").alias("source"), F.col("applies_to").alias("investor"), "status")
