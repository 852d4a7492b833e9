"""Streams: package intake with the batch code, and windowed severity counts with late data and repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SEVERITIES
from ..sources.documents import packages_from_table
from ..sources.shred import unreadable_packages


def stream_packages(stream: DataFrame, id_col: str = "doc_id", text_col: str = "xml_text") -> DataFrame:
    """STM1: intake findings of an unbounded table of packages; stateless, so append mode works."""
    return unreadable_packages(packages_from_table(stream, id_col, text_col))


def severity_counts(findings: DataFrame, window: str = "1 day") -> DataFrame:
    """Counts of the four severities per tumbling window; works on batch and stream alike."""
    return (
        findings.groupBy(F.window("created_at", window).alias("w"))
        .agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
        .select(F.col("w.start").alias("window_start"), *SEVERITIES)
    )


def stream_severity_counts(findings: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """STM2: late rows are dropped behind the watermark, a finding id counts once within it; state is bounded by both."""
    once = findings.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["finding_id"])
    return severity_counts(once, window)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives back its result as a table (for tests and back-fills of small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
