"""Findings, reports and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import mint_path_iri, strip
from ..schemas import BASE, SEVERITIES

DEFAULT_RULE_SETS = ("default",)
INVESTORS = ("first", "second", "both")


def schema_reports(documents: DataFrame, findings: DataFrame, not_well_formed: str = "not-well-formed") -> DataFrame:
    """FND1: one report per document, passed ones included: well_formed, schema_valid, status and derived counts."""
    count = lambda s: F.count_if(F.col("severity") == s)
    per = findings.groupBy("doc_id").agg(count("warning").alias("w"), count("error").alias("e"), F.count_if(F.col("error_code") == not_well_formed).alias("m"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = documents.join(per, "doc_id", "left").select("doc_id", "package_name", z("w").alias("warning_count"), z("e").alias("error_count"), (z("m") == 0).alias("well_formed"))
    passed = F.col("well_formed") & (F.col("error_count") == 0)
    return out.select(
        "doc_id", "package_name", "well_formed", passed.alias("schema_valid"), F.when(passed, "passed").otherwise("failed").alias("status"),
        "warning_count", "error_count", (F.col("warning_count") + F.col("error_count")).alias("finding_count"),
    )


def severity_summary(findings: DataFrame, by: str = "run_id") -> DataFrame:
    """FND2: counts of the four severities per run, zero-filled; other severities don't count."""
    return findings.groupBy(by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def validation_runs(packages: DataFrame, findings: DataFrame, rules: DataFrame, supported_version: str = "1.0") -> DataFrame:
    """FND3: one run per package with scope, sorted rule set versions (a default where there are none) and summary."""
    versions = rules.agg(F.array_sort(F.collect_set("source_version")).alias("v")).first()["v"] or list(DEFAULT_RULE_SETS)
    counts = severity_summary(findings, "doc_id")
    out = packages.select("doc_id", "package_name", "investor_scope").join(counts, "doc_id", "left")
    run = F.concat(F.lit("VR-"), F.substring(F.sha2(F.concat_ws("\x1f", "doc_id", "investor_scope"), 256), 1, 12))
    return out.select(
        run.alias("run_id"), "doc_id", F.lit(supported_version).alias("supported_version"), "investor_scope",
        F.array(*[F.lit(v) for v in versions]).alias("rule_set_versions"), *[F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in SEVERITIES],
    )


def rules_in_scope(rules: DataFrame, scope: str, both: str = "both") -> DataFrame:
    """FND4: all rules for both investors; else the investor's own and the shared ones."""
    return rules if scope == both else rules.where(F.col("applies_to").isin(scope, both))


def split_by_investor(findings: DataFrame, by: str = "doc_id", first: str = "first", second: str = "second", both: str = "both") -> DataFrame:
    """FND5: per document how many findings concern only the first, only the second, or both investors."""
    count = lambda s: F.count_if(F.col("investor") == s)
    return findings.groupBy(by).agg(count(first).alias("first_only"), count(second).alias("second_only"), count(both).alias("shared"))


def explain_findings(ids: DataFrame, findings: DataFrame) -> DataFrame:
    """FND6: a sentence per asked ``finding_id``; unknown ids get a fixed one."""
    known = findings.select("finding_id", "source_section", "observed_value", "expected_condition", F.lit(True).alias("known"))
    or_else = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    told = F.format_string(
        "Finding %s is based on %s. Observed value: %s. Expected condition: %s.", F.col("finding_id"), F.coalesce("source_section", F.lit("the governing rule")),
        or_else("observed_value", "not applicable"), or_else("expected_condition", "see source rule"),
    )
    missing = F.format_string("No stored finding was found for %s. Explanation is unavailable.", F.col("finding_id"))
    return ids.join(known, "finding_id", "left").select("finding_id", F.when(F.col("known"), told).otherwise(missing).alias("explanation"))


#: Fixed texts of the review comments.
BLANK_REVIEW = "Revision History Detail is empty or blank."
NO_REFERENCE = "Revision History Detail does not explicitly reference the related finding identifiers."
ALL_CLEAR = "Revision History Detail is present. Advisory review did not identify an obvious omission."


def review_texts(reviews: DataFrame, text: str = "text", ids: str = "related_finding_ids") -> DataFrame:
    """FND7: ``comments``: on blank texts, on texts that name none of the related findings, else an all-clear."""
    t = F.coalesce(F.col(text), F.lit(""))
    related = F.coalesce(F.col(ids), F.array().cast("array<string>"))
    blank = F.when(strip(t) == "", BLANK_REVIEW)
    unnamed = F.when((F.size(related) > 0) & ~F.exists(related, lambda x: t.contains(x)), NO_REFERENCE)
    found = F.filter(F.array(blank, unnamed), lambda x: x.isNotNull())
    return reviews.withColumn("comments", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(ALL_CLEAR))))


def finding_ids(findings: DataFrame, run: str = "run_id", content: tuple[str, ...] = ("data_location", "error_code", "message"), base: str = BASE) -> DataFrame:
    """FND8: ids and IRIs from what a finding says, so a second run gives the same ones; equal findings are numbered."""
    w = Window.partitionBy(run, *content).orderBy(*content)
    nth = F.row_number().over(w)
    key = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (run, *content)], nth.cast("string")), 256)
    out = findings.withColumn("finding_id", F.concat(F.lit("F-"), F.substring(key, 1, 16)))
    return out.withColumn("finding_iri", mint_path_iri(F.lit("finding"), F.col(run).cast("string"), F.col("finding_id"), base=base))
