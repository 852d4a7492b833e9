"""Helpers shared by the operators of this package: lineage cuts, size-checked broadcasts, graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if it has at most this many (narrow) rows by an actual count.
BROADCAST_ROWS = 200_000
#: A key is hot if more than one row of this many has it, so there are fewer hot keys than this.
HOT = 1000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share. A folder of this machine is made only for a local session that names none."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shapeforge-checkpoint-"))
        known = sc.getCheckpointDir()
    return known


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as a table to the shared folder and read from there, and the table's path."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a table in the shared folder: lineage ends there, so lost executors cost little."""
    return store(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``store`` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one operator's run, deleted together when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        out, path = store(df)
        self.paths.append(path)
        return out

    def clear(self) -> None:
        for path in self.paths:
            discard(self.spark, path)
        self.paths = []


def free_name(columns: list[str], name: str = "row") -> str:
    """``name``, made longer until no column is called so."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already cut) with a broadcast hint if an actual count shows that it is small; else as it is."""
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def join_split(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` joined with the one row that ``side`` has for a ``key``. ``hot`` names fewer than ``HOT`` keys, whose rows meet a
    broadcast instead of a shuffle; so no task gets a large group."""
    hot = F.broadcast(hot)
    many = rows.join(F.broadcast(side.join(hot, key, "left_semi")), key)
    return many.unionByName(rows.join(hot, key, "left_anti").join(side, key))


def _met(edges: DataFrame, nodes: DataFrame, end: str, rows: int) -> DataFrame:
    """``hi, lo, m``: the edges with what ``nodes`` (``node, m, n``: n of the edges end there) holds of one end. Nodes of more than
    a thousandth of the edges are broadcast; their edges are spread by a salt that no node has."""
    many = F.col("n") > rows / HOT
    hot = F.broadcast(nodes.where(many).select(F.col("node").alias(end), F.col("m").alias("hot_m"), F.lit(True).alias("hot")))
    rest = nodes.where(~many).select(F.col("node").alias(end), "m", F.lit(0).alias("salt"))
    dealt = edges.join(hot, end, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("hi", "lo"), F.lit(9973)).cast("int") + 1).otherwise(0))
    return dealt.join(rest, [end, "salt"], "left").select("hi", "lo", F.coalesce("hot_m", "m").alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """Smallest id reachable from each node: ``node, component``. Nodes without an edge do not appear.

    Alternates large-star and small-star steps (Kiveris et al. 2014) on edges kept as (higher, lower) until a round changes
    nothing, so every node has one edge, to a node without one: the number of rounds grows with the logarithm of the longest
    path, every round has edges at most linear in the input, and minima are pre-aggregated before the shuffle. A node that ends
    more than a thousandth of the edges meets its minimum by broadcast, so a large star is no task's own. A round writes
    two tables, from plans of a few joins, and deletes those before; the last one is the result's, and ``scratch``'s to delete
    where one is given. Raises if ``max_rounds`` rounds were not enough.
    """
    spark = edges.sparkSession
    e, path = store(
        edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).distinct()
    )
    state = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == state:
            break
        state = now
        end = lambda node, m, n: F.struct(F.col(node).alias("node"), m.alias("m"), F.lit(n).alias("n"))
        ends = F.array(end("hi", F.col("lo"), 0), end("lo", F.lit(None).cast(e.schema["lo"].dataType), 1))
        nodes = e.select(F.explode(ends).alias("end")).select("end.*").groupBy("node").agg(F.min("m").alias("m"), F.sum("n").alias("n"))
        # large star: an edge's lower end becomes that end's own minimum
        big, made = store(_met(e, nodes, "lo", now[0]).select("hi", F.coalesce("m", "lo").alias("lo")))
        # small star: all lower ends of a node, and the node, go to the least of them
        nodes = big.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        rest = _met(big, nodes, "hi", now[0]).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        gone = [path, made]
        e, path = store(rest.unionByName(nodes.select(F.col("node").alias("hi"), F.col("m").alias("lo"))).distinct())
        for old in gone:
            discard(spark, old)
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    if scratch is not None:
        scratch.paths.append(path)
    tops = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(tops)
