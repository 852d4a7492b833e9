"""Iteration to a fixpoint: rounds of joins whose tables live in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share; a folder of this machine is made only for a local session that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shapeforge-checkpoint-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as a table to the shared folder and read from there, and its path: lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def grown(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], most: int = 100_000, together: int = 16) -> DataFrame:
    """The least set of rows that holds ``start`` and, with any rows, what ``step`` makes of them; one row a ``key`` (no nulls), the
    first found.

    Semi-naive: a round steps from the rows that the round before added, and cycles end since nothing is added twice. Each round
    writes its new rows as a table, so no plan grows with the number of rounds: after ``together`` rounds their tables are put
    together to one. Raises after ``most`` rounds.
    """
    spark, cols = start.sparkSession, start.columns
    front, path = stored(start.dropDuplicates(key))
    known, paths = front, [path]
    for _ in range(most):
        front, path = stored(step(front).select(*cols).dropDuplicates(key).join(known.select(*key), key, "left_anti").select(*cols))
        if front.isEmpty():
            discard(spark, path)
            return known
        known, paths = known.unionByName(front), [*paths, path]
        if len(paths) > together:
            # the front stays a table of its own
            whole, path = stored(known)
            discard(spark, *paths[:-1])
            known, paths = whole, [path, paths[-1]]
    raise RuntimeError(f"no fixpoint after {most} rounds")
