"""Measurements over validated graphs, and coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import TYPE


def completeness(counts: DataFrame) -> DataFrame:
    """MEA1: per graph the required (focus, path) pairs that have enough values over all required ones."""
    need = counts.where("least > 0")
    return need.groupBy("graph_id").agg(F.count_if(F.col("n_values") >= F.col("least")).alias("satisfied"), F.count(F.lit(1)).alias("required")).withColumn("completeness", F.col("satisfied") / F.col("required"))


def consistency(triples: DataFrame, single_valued: list[str]) -> DataFrame:
    """MEA2: single-valued paths of a subject that differ across graphs."""
    rows = triples.where(F.col("p").isin(*single_valued)).groupBy("s", "p").agg(F.count_distinct("o").alias("n_values"), F.count_distinct("graph_id").alias("n_graphs"))
    return rows.where("n_values > 1 and n_graphs > 1")


def evidence_coverage(triples: DataFrame, cls: str, path: str) -> DataFrame:
    """MEA3: one row: nodes of a class, those with at least one value of the path, their share."""
    nodes = triples.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("graph_id", "s").distinct()
    have = triples.where(F.col("p") == path).select("graph_id", "s").distinct().withColumn("hit", F.lit(1))
    out = nodes.join(have, ["graph_id", "s"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_covered"))
    return out.withColumn("coverage", F.col("n_covered") / F.col("n"))


def comparables_per_report(triples: DataFrame, path: str, graphs: DataFrame) -> DataFrame:
    n = triples.where(F.col("p") == path).groupBy("graph_id").agg(F.count_distinct("o").alias("n"))
    return graphs.select("graph_id").distinct().join(n, "graph_id", "left").select("graph_id", F.coalesce("n", F.lit(0)).alias("n"))


def comparable_distribution(triples: DataFrame, path: str, graphs: DataFrame) -> DataFrame:
    """MEA4: one row: reports, least, most, quartiles of comparables per report."""
    q = lambda x: F.percentile("n", x)
    return comparables_per_report(triples, path, graphs).agg(F.count(F.lit(1)).alias("n_reports"), F.min("n").alias("least"), F.max("n").alias("most"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))


def most_reused_comparables(triples: DataFrame, path: str, k: int) -> DataFrame:
    """MEA4: the ``k`` values used in most reports; ties to the smaller name."""
    return triples.where(F.col("p") == path).groupBy(F.col("o").alias("comparable")).agg(F.count_distinct("graph_id").alias("n_reports")).orderBy(F.desc("n_reports"), "comparable").limit(k)


def rule_compliance(evaluated: DataFrame, failed: DataFrame, by: list[str]) -> DataFrame:
    """MEA5: per rule: evaluated, failed, pass rate; ``failed`` rows are distinct by focus."""
    e = evaluated.groupBy(*by).agg(F.count(F.lit(1)).alias("evaluated"))
    f = failed.groupBy(*by).agg(F.count(F.lit(1)).alias("failed"))
    out = e.join(f, by, "left").withColumn("failed", F.coalesce("failed", F.lit(0)))
    return out.withColumn("pass_rate", (F.col("evaluated") - F.col("failed")) / F.col("evaluated"))


PLACEHOLDER = "TBD"


def competency_coverage(samples: DataFrame, bridge: DataFrame, competencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RPT1: (samples per competency, none included; competencies and samples per use case). Placeholders don't count."""
    real = bridge.where(F.col("competency_id") != PLACEHOLDER).distinct()
    per = real.groupBy("competency_id").agg(F.count_distinct("sample_id").alias("n"))
    a = competencies.select("competency_id").distinct().join(per, "competency_id", "left").select("competency_id", F.coalesce("n", F.lit(0)).alias("n_samples"))
    b = samples.join(real, "sample_id", "left").groupBy("use_case").agg(F.count_distinct("competency_id").alias("n_competencies"), F.count_distinct("sample_id").alias("n_samples"))
    return a, b


def competency_gaps(samples: DataFrame, bridge: DataFrame, competencies: DataFrame) -> DataFrame:
    """RPT2: ``use_case, competency_id``: competencies that samples of a use case exercise and no shape covers."""
    used = samples.join(bridge.where(F.col("competency_id") != PLACEHOLDER), "sample_id").select("use_case", "competency_id").distinct()
    return used.join(competencies.where(F.col("shape").isNotNull() & (F.col("shape") != "-")), "competency_id", "left_anti")


def sample_status_summary(samples: DataFrame) -> DataFrame:
    """RPT3: samples by use case, expected result and statuses."""
    return samples.groupBy("use_case", "expected_result", "validation_status", "projection_status").agg(F.count(F.lit(1)).alias("n_samples"))


def top_findings(findings: DataFrame, k: int, min_packages: int = 2, min_sources: int = 2) -> DataFrame:
    """RPT4: the ``k`` most frequent signatures with packages affected; systemic ones stand in enough packages of enough sources."""
    rows = findings.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_packages"), F.count_distinct("source").alias("n_sources"))
    return rows.withColumn("systemic", (F.col("n_packages") >= min_packages) & (F.col("n_sources") >= min_sources)).orderBy(F.desc("n"), "signature").limit(k)
