"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are projected on random directions; floor((a.x + b) / width) of several projections together name a
bucket, in several tables. Vectors that meet in a bucket of any table are checked by their exact cosine in double
precision. The number of projections follows the number of vectors (buckets stay small), and the number of tables
follows from it so that a pair at the threshold is met with probability ``recall``, closer pairs more surely.

Equal vectors are one class with a count, so copies cost one row. A bucket's pairs never become rows. Buckets of up to
``BLOCK`` vectors are dealt to cells of about ``CELL`` rows, each vector once a table, and a cell checks the pairs of all its
buckets together; only larger buckets are cut into blocks, and checked block against block with one matrix product (their
vectors are near each other, so most of these pairs are links that have to be counted). Each pair is counted in the first
table in which the two meet (their keys in all tables are at hand). A task gives back a count per vector and stars that
connect what its links connect, both linear in its rows.

Defined results: null, empty, zero vectors and those with null or non-finite components link with nothing and are kept;
vectors of different lengths don't link; repeated ids are one vector each for the counts but share a row (the largest
count and the smallest component); rows without an id are one row without links; other columns, whatever their names, are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut
from .vectors import matrix, usable_vectors

WIDTH = 2.0
#: Rows of a block; a task checks one block against another.
BLOCK = 1024
#: Rows of a cell of smaller buckets, about; pairs that are checked at once.
CELL, TOGETHER = 4096, 1 << 16


def _meet(distance: float, width: float = WIDTH) -> float:
    """Probability that one projection puts two points at ``distance`` into one slot."""
    c = width / distance
    phi = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def plan_tables(n: int, threshold: float, recall: float = 0.95) -> tuple[int, int]:
    """(projections a table, tables): unrelated vectors, at distance sqrt(2), meet about 64 times each."""
    far = _meet(math.sqrt(2))
    near = _meet(math.sqrt(2 - 2 * threshold))
    k = max(4, math.ceil(math.log(max(n, 2) / 64) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**k))))


def _forest(links: np.ndarray, rows: np.ndarray, cols: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what a block's links connect: (id, smallest id of its part of the block)."""
    none = np.iinfo(np.int64).max
    lr, lc = np.where(links.any(1), rows, none), np.where(links.any(0), cols, none)
    while True:
        nr = np.minimum(lr, np.where(links, lc, none).min(1, initial=none))
        nc = nr if same else np.minimum(lc, np.where(links, nr[:, None], none).min(0, initial=none))
        if (nr == lr).all() and (nc == lc).all():
            break
        lr, lc = nr, nc
    ids, tops = (rows, lr) if same else (np.concatenate((rows, cols)), np.concatenate((lr, lc)))
    real = (tops != none) & (tops != ids)
    return ids[real], tops[real]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths, in double precision, safe from overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_FOUND = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("edge", pa.bool_())])


def _check(threshold: float, block: pa.Table) -> pa.Table:
    """Links of one bucket's block pair: rows of side 0 against rows of side 1 (or the block against itself)."""
    block = block.combine_chunks()
    x = block.column("x").chunk(0)
    size = np.diff(x.offsets.to_numpy())
    if (size != size[0]).any():  # two buckets that share a name: each length by itself
        return pa.concat_tables([_check(threshold, block.filter(pa.array(size == d))) for d in np.unique(size)])
    u = _unit(x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(size), -1))
    side, rep, n = (block.column(c).to_numpy() for c in ("side", "rep", "n"))
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    same = not len(right)
    right = left if same else right
    links = u[left] @ u[right].T >= threshold
    if same:
        np.fill_diagonal(links, False)
    table = block.column("tab")[0].as_py()
    if table and links.any():
        keys = np.frombuffer(b"".join(block.column("keys").to_pylist()), np.int32).reshape(len(size), -1)[:, :table]
        i, j = np.nonzero(links)
        for at in range(0, len(i), 65536):  # pairs that met in an earlier table were counted there
            a, b = i[at : at + 65536], j[at : at + 65536]
            met = (keys[left[a]] == keys[right[b]]).any(1)
            links[a[met], b[met]] = False
    if not links.any():
        return _FOUND.empty_table()
    rid, cid = rep[left], rep[right]
    counts = [(rid, links @ n[right])]
    if not same:
        counts.append((cid, links.T @ n[left]))
    a, b = _forest(links, rid, cid, same)
    who = np.concatenate([w[c > 0] for w, c in counts] + [a])
    return pa.table({
        "rep": who, "other": np.concatenate([np.full(len(who) - len(a), -1), b]),
        "n": np.concatenate([c[c > 0] for _, c in counts] + [np.zeros(len(a), np.int64)]), "edge": np.arange(len(who)) >= len(who) - len(a),
    }, schema=_FOUND)


def _parts(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row number that pairs connect each of ``n`` rows to."""
    top = np.arange(n)
    while True:
        new = top.copy()
        np.minimum.at(new, a, top[b])
        np.minimum.at(new, b, top[a])
        new = new[new]
        if (new == top).all():
            return top
        top = new


def _check_cell(threshold: float, cell: pa.Table) -> pa.Table:
    """Links within each bucket of a cell."""
    cell = cell.combine_chunks()
    size = np.diff(cell.column("x").chunk(0).offsets.to_numpy())
    if (size != size[0]).any():  # each length by itself
        return pa.concat_tables([_check_cell(threshold, cell.filter(pa.array(size == d))) for d in np.unique(size)])
    tab, key, rep, n = (cell.column(c).to_numpy() for c in ("tab", "key", "rep", "n"))
    order = np.lexsort((rep, key, tab))
    tab, key, rep, n = tab[order], key[order], rep[order], n[order]
    u = _unit(cell.column("x").chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(size), -1))[order]
    keys = np.frombuffer(b"".join(cell.column("keys").to_pylist()), np.int32).reshape(len(size), -1)[order]
    starts = np.flatnonzero(np.concatenate(([True], (tab[1:] != tab[:-1]) | (key[1:] != key[:-1]))))
    sizes = np.diff(np.concatenate((starts, [len(tab)])))
    found = [np.zeros((2, 0), np.int64)]
    for s in np.unique(sizes[sizes > 1]):  # the buckets of one size together
        i, j = np.triu_indices(s, 1)
        first, step = starts[sizes == s], max(1, TOGETHER // len(i))
        for at in range(0, len(first), step):
            some = first[at : at + step, None]
            a, b = (some + i).ravel(), (some + j).ravel()
            for k in range(0, len(a), TOGETHER):
                p, q = a[k : k + TOGETHER], b[k : k + TOGETHER]
                hit = np.einsum("ij,ij->i", u[p], u[q]) >= threshold
                p, q = p[hit], q[hit]
                # pairs that met in an earlier table were counted there
                new = (keys[p] == keys[q]).argmax(1) == tab[p]
                found.append(np.stack((p[new], q[new])))
    a, b = np.concatenate(found, axis=1)
    if not len(a):
        return _FOUND.empty_table()
    # one vector may stand in several buckets of the cell: its rows are one node
    ids, node = np.unique(rep, return_inverse=True)
    counts = np.bincount(node[a], n[b], len(ids)) + np.bincount(node[b], n[a], len(ids))
    top = _parts(node[a], node[b], len(ids))
    told, joined = np.flatnonzero(counts), np.flatnonzero(top != np.arange(len(ids)))
    return pa.table({
        "rep": np.concatenate((ids[told], ids[joined])), "other": np.concatenate((np.full(len(told), -1), ids[top[joined]])),
        "n": np.concatenate((counts[told].astype(np.int64), np.zeros(len(joined), np.int64))), "edge": np.arange(len(told) + len(joined)) >= len(told),
    }, schema=_FOUND)


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.95, seed: int = 5) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row's id."""
    spark = df.sparkSession
    vectors = usable_vectors(df, id_col, vec_col)
    kind = dict(vectors.dtypes)["v"]
    # copies: one class per distinct vector
    classes = cut(vectors.groupBy("v").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("n")))
    size = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    k, tables = plan_tables(size[0] or 0, threshold, recall)
    dims = size[1] or 1
    rng = np.random.default_rng(seed)
    plan = spark.sparkContext.broadcast((rng.normal(size=(dims, tables * k)), rng.uniform(0, WIDTH, tables * k), rng.integers(1, 2**62, k) | 1))

    def keys(it):
        a, b, mult = plan.value
        for pdf in it:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                for _, group in part.groupby(part["v"].map(len)):
                    x = matrix(group["v"])
                    u = _unit(x)
                    slot = np.floor((u @ a[: u.shape[1]] + b) / WIDTH).astype(np.int64).reshape(len(u), tables, k)
                    with np.errstate(over="ignore"):
                        key = ((slot + 1024) * mult).sum(2) * 0x9E3779B97F4A7C1 + u.shape[1]
                    key = (key >> 32).astype(np.int32)  # a bucket that two names share costs a check, no more
                    yield pd.DataFrame({"rep": group["rep"], "n": group["n"], "x": group["v"], "keys": [q.tobytes() for q in key], "key": list(key)})

    hashed = cut(classes.mapInPandas(keys, f"rep long, n long, x {kind}, keys binary, key array<int>"))
    met = hashed.select("rep", F.posexplode("key").alias("tab", "key"))
    sizes = met.groupBy("tab", "key").agg(F.count("*").alias("size")).where("size > 1")
    sizes = cut(sizes.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")))
    members, vectors_of = met.join(sizes, ["tab", "key"]), hashed.select("rep", "n", "x", "keys")
    total = sizes.where("blocks = 1").agg(F.sum("size")).first()[0] or 0
    dealt = members.where("blocks = 1").select("tab", "key", "rep", F.pmod(F.xxhash64("tab", "key"), F.lit(max(1, -(-total // CELL)))).alias("cell"))
    schema = "rep long, other long, n long, edge boolean"
    found = dealt.join(vectors_of, "rep").groupBy("cell").applyInArrow(lambda cell: _check_cell(threshold, cell), schema)
    large = sizes.where("blocks > 1")
    if large.limit(1).count():
        # a block meets itself and every other block of its bucket once
        cuts = members.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        pairs = cuts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "tab", "key", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "rep"
        )
        found = found.unionByName(pairs.join(vectors_of, "rep").groupBy("tab", "key", "b0", "b1").applyInArrow(lambda block: _check(threshold, block), schema))
    found = cut(found)
    degree = found.where("not edge").groupBy("rep").agg(F.sum("n").alias("d"))
    groups = connected_components(found.where("edge"), "rep", "other").select(F.col("node").alias("rep"), "component")
    by_class = classes.join(degree, "rep", "left").join(groups, "rep", "left")
    by_class = by_class.select("v", (F.coalesce("d", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    own = vectors.join(by_class, "v").groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    ids = df.select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    out = ids.join(own, "vec_id", "left")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
