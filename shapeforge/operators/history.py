"""Quality over time. Rows are aggregated to days or runs before any window, so windows run over short tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deliverable(runs: DataFrame) -> DataFrame:
    """HIS1: latest run per package; deliverable if it has no error and no critical finding. Equal times: larger run id."""
    last = runs.groupBy("package_id").agg(F.max(F.struct("created_at", "run_id", "error", "critical")).alias("r"))
    return last.select("package_id", "r.run_id", "r.created_at", ((F.col("r.error") == 0) & (F.col("r.critical") == 0)).alias("deliverable"))


def quality_trend(runs: DataFrame, findings: str = "n_findings", by: list[str] | None = None) -> DataFrame:
    """HIS2: findings per run by day, difference to the day before in the table, average of up to seven rows."""
    by = by or []
    day = runs.groupBy(*by, F.to_date("created_at").alias("day")).agg((F.sum(findings) / F.count(F.lit(1))).alias("findings_per_run"))
    w = Window.partitionBy(*by).orderBy("day")
    return day.withColumn("change", F.col("findings_per_run") - F.lag("findings_per_run").over(w)).withColumn("moving_average", F.avg("findings_per_run").over(w.rowsBetween(-6, 0)))


def time_to_repair(runs: DataFrame) -> DataFrame:
    """HIS3: per package the first failing run, the first passing one after it, and the seconds between."""
    order = Window.partitionBy("package_id").orderBy("created_at", "run_id")
    nxt = F.min(F.when(F.col("passed"), F.col("created_at"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    failing = runs.withColumn("repaired_at", nxt).where(~F.col("passed"))
    first = failing.groupBy("package_id").agg(F.min(F.struct("created_at", "run_id", "repaired_at")).alias("f"))
    secs = F.unix_micros(F.col("f.repaired_at").cast("timestamp")) - F.unix_micros(F.col("f.created_at").cast("timestamp"))
    return first.select("package_id", F.col("f.created_at").alias("failed_at"), F.col("f.repaired_at").alias("repaired_at"), (secs / 1e6).alias("seconds"))


def source_benchmark(runs: DataFrame, min_runs: int, salt: str = "") -> DataFrame:
    """HIS4: sources by error rate; keys are hashed, sources with too few runs are left out."""
    rows = runs.groupBy("source").agg(F.count(F.lit(1)).alias("n_runs"), F.avg(F.when(F.col("passed"), 0.0).otherwise(1.0)).alias("error_rate")).where(F.col("n_runs") >= min_runs)
    w = Window.orderBy("error_rate")  # one row per source
    key = F.substring(F.sha2(F.concat(F.lit(salt), F.col("source").cast("string")), 256), 1, 16)
    return rows.select(key.alias("source_key"), "n_runs", "error_rate", F.rank().over(w).alias("rank"), F.percent_rank().over(w).alias("percent_rank"))


def version_comparison(runs: DataFrame, metric: str = "n_findings") -> DataFrame:
    """HIS5: mean of the metric per source and version, and the change from the version before."""
    rows = runs.groupBy("source", "version").agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).alias("n_runs"))
    return rows.withColumn("change", F.col("mean") - F.lag("mean").over(Window.partitionBy("source").orderBy("version")))
