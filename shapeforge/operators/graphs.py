"""Graph tables: sets of triples keyed by graph. Node names repeat between graphs, so every key carries ``graph_id``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import RDF, RDFS
from .fixpoint import discard, stored

KEY = ("graph_id", "s", "p", "o", "o_kind", "o_datatype", "o_lang")
TYPE, SUBCLASS = RDF + "type", RDFS + "subClassOf"


def merge_graphs(*graphs: DataFrame) -> DataFrame:
    """GRF1: set union. An ontology that all graphs share stays a side table instead of being copied into each."""
    return reduce(DataFrame.unionByName, graphs).dropDuplicates()


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """GRF2: triples of a pattern; the filters reach the scan."""
    for col, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(col) == value)
    return triples


def match_many(triples: DataFrame, patterns: DataFrame, on: list[str]) -> DataFrame:
    """GRF2: triples that agree with any row of ``patterns``."""
    return triples.join(patterns.select(*on).distinct(), on, "left_semi")


def graph_diff(a: DataFrame, b: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """GRF3: every triple of either graph with ``side``: shared, first or second (ground graphs; one shuffle per side)."""
    cols = [c for c in by if c in a.columns]
    both = a.select(*cols).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(b.select(*cols).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    one = both.groupBy(*cols).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    side = F.when(F.col("_a") + F.col("_b") == 2, "shared").when(F.col("_a") == 1, "first").otherwise("second")
    return one.select(*cols, side.alias("side"))


#: A closure of up to so many pairs is worked out by the driver and is a local table with a known size.
LOCAL_PAIRS = 200_000


def subclass_closure(ontology: DataFrame, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """GRF4: reflexive-transitive ``sub, super`` over the subclass axioms; cycles end, since pairs are a set.

    Ontologies are small next to instance data. Where the closure has more pairs than ``local_pairs``, the pairs are joined
    with themselves until nothing is new; each step doubles the length of the paths known. Both ways give the same rows.
    """
    is_sub = F.col("p") == SUBCLASS
    ends = F.when(is_sub, F.array("s", "o")).otherwise(F.array("s"))
    facts = ontology.where(is_sub | (F.col("p") == TYPE)).select(F.when(is_sub, F.col("s")).alias("sub"), F.when(is_sub, F.col("o")).alias("super"), ends.alias("ends")).distinct()
    some = facts.limit(local_pairs + 1).collect()
    pairs = _walked(some, local_pairs) if len(some) <= local_pairs else None
    if pairs is not None:
        return ontology.sparkSession.createDataFrame(pairs, "sub string, super string")
    pairs = facts.where("sub is not null").select("sub", "super").unionByName(facts.select(F.explode("ends").alias("sub")).select("sub", F.col("sub").alias("super"))).distinct()
    pairs, path = stored(pairs)
    known = pairs.count()
    while True:
        a, b, old = pairs.alias("a"), pairs.alias("b"), path
        pairs, path = stored(a.join(b, F.col("a.super") == F.col("b.sub")).select("a.sub", "b.super").distinct())
        discard(ontology.sparkSession, old)
        now = pairs.count()
        if now == known:
            return pairs
        known = now


def _walked(facts: list, most: int) -> list[tuple[str, str]] | None:
    """The closure of collected axioms, or None once it has more than ``most`` pairs."""
    up: dict[str, set[str]] = {}
    for r in facts:
        for x in r["ends"]:
            up.setdefault(x, set())
        if r["sub"] is not None:
            up[r["sub"]].add(r["super"])
    pairs: list[tuple[str, str]] = []
    for x in up:
        seen, todo = {x}, [x]
        while todo and len(pairs) + len(seen) <= most:
            new = up[todo.pop()] - seen
            seen |= new
            todo += new
        pairs += [(x, y) for y in seen]
        if len(pairs) > most:
            return None
    return pairs


def graph_sizes(triples: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """GRF5: ``graph_id, n_triples, is_empty``; graphs of the list that have no triple count 0."""
    sizes = triples.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_triples"))
    if graphs is not None:
        sizes = graphs.select("graph_id").distinct().join(sizes, "graph_id", "left")
    return sizes.select("graph_id", F.coalesce("n_triples", F.lit(0)).alias("n_triples")).withColumn("is_empty", F.col("n_triples") == 0)


def focus_count_check(triples: DataFrame, cls: str, n: int = 1, graphs: DataFrame | None = None) -> DataFrame:
    """GRF6: ``graph_id, n_focus, ok``: whether each graph has exactly ``n`` subjects of a class."""
    typed = (F.col("p") == TYPE) & (F.col("o") == cls)
    if graphs is None:
        # graphs are those of the triples: one pass counts and lists them
        counts = triples.groupBy("graph_id").agg(F.count_distinct(F.when(typed, F.col("s"))).alias("n_focus"))
        return counts.withColumn("ok", F.col("n_focus") == n)
    counts = triples.where(typed).groupBy("graph_id").agg(F.count_distinct("s").alias("n_focus"))
    every = graphs.select("graph_id").distinct()
    return every.join(counts, "graph_id", "left").select("graph_id", F.coalesce("n_focus", F.lit(0)).alias("n_focus")).withColumn("ok", F.col("n_focus") == n)
