"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one full-dimensional codeword from each of several codebooks. The codebooks are fitted on
residuals of a bounded sample; codes are found by beam search, and the norm of the coded vector is stored, so that a
query's distance to every coded vector is a sum of looked-up inner products plus that norm. The best of all are reranked
with exact distances of the original vectors.

Queries and codes meet in tiles: blocks of at most ``QUERY_TILE`` queries against one of at most ``SHARDS`` shards of the codes,
both cut by hash. A tile's codes pass by in batches while its queries keep their nearest, so its memory is bounded whatever the
size of the tables, and a query has at most ``SHARDS`` shortlists. Every code is looked at for every query, so that work is the product
of their numbers. Only ids, codes and norms go through the tiles; the shortlists are merged by estimate to one of ``shortlist_size`` a
query, and original vectors are joined to that.

Defined results: null, empty, zero vectors and those with null or non-finite components take no part; vectors of another
length than the most usual one of the sample take no part; where an id is repeated its rows are candidates of their own
and the nearest stands for the id, and the least of its vectors is the query; equal distances go to the smaller id, also in
the shortlist; fewer candidates than ``k`` give fewer rows; other columns, whatever their names, are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import matrix, usable_vectors

BOOKS, WORDS, BEAM = 16, 256, 4
#: The codebooks are fitted on at most so many vectors, the first by hash of the id.
SAMPLE = 8192
#: Codes of a shard at least, and shards at most: a query has one shortlist a shard, so their number must not grow.
SHARD, SHARDS = 8192, 4
#: Queries of a tile at most, and, while there are fewer than TILES tiles, at least.
QUERY_TILE, SMALL_TILE, TILES = 8192, 128, 4
#: Candidates of a query that are reranked exactly: this share of all vectors, but this many at most.
SHARE, SHORTLIST = 0.05, 400


def shortlist_size(n: int, k: int) -> int:
    """Four times what is asked for at least: 40 of 500 vectors, 400 of 8,000 and more."""
    return max(4 * k, min(SHORTLIST, int(SHARE * n)))


@dataclass
class Codebooks:
    words: np.ndarray  # books x words x dims, float32
    scale: float = 1.0  # vectors are divided by it before coding, so that squares stay finite

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x / self.scale, -1e15, 1e15).astype(np.float32)

    def __post_init__(self):
        m, k, d = self.words.shape
        flat = self.words.reshape(m * k, d)
        self.gram = (flat @ flat.T).astype(np.float32).reshape(m, k, m, k)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes n x books, squared norms of the coded vectors) by beam search over the codebooks in turn."""
        m, k, d = self.words.shape
        n = len(x)
        inner = (x @ self.words.reshape(m * k, d).T).reshape(n, m, k)
        norms = np.einsum("mkmk->mk", self.gram)
        rows = np.arange(n)[:, None]
        codes, error, width = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32), 1
        for b in range(m):
            # |x - s - c|^2 = |x - s|^2 + |c|^2 - 2 <x, c> + 2 <s, c>, where s is the sum so far
            cost = error[:, :, None] + norms[b] - 2 * inner[:, None, b]
            for a in range(b):
                cost = cost + 2 * self.gram[a, codes[:, :, a], b]
            flat = cost.reshape(n, width * k)
            keep = min(beam, flat.shape[1])
            top = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            error = flat[rows, top]
            codes = np.concatenate((codes[rows, top // k], (top % k)[:, :, None]), axis=2)
            width = keep
        best = codes[np.arange(n), error.argmin(1)]
        coded = np.zeros((n, d), np.float32)
        for b in range(m):
            coded += self.words[b, best[:, b]]
        return best.astype(np.uint8 if k <= 256 else np.uint16), (coded * coded).sum(1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    if len(c) < k:
        c = np.concatenate((c, np.zeros((k - len(c), x.shape[1]), x.dtype)))
    for _ in range(rounds):
        who = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(who, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, who, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(x.dtype)
    return c


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 11) -> Codebooks:
    """Residual k-means, one codebook after the other."""
    rng = np.random.default_rng(seed)
    scale = float(np.median(np.abs(x).max(1))) or 1.0
    rest, out = np.clip(x / scale, -1e3, 1e3).astype(np.float32), []
    for _ in range(books):
        c = _k_means(rest, words, rng)
        out.append(c)
        rest = rest - c[((c * c).sum(1) - 2 * rest @ c.T).argmin(1)]
    return Codebooks(np.stack(out), scale)


def sample_fit(vectors: DataFrame, sample: int = SAMPLE, **options) -> Codebooks | None:
    """Fit on the first ``sample`` vectors by hash of the id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"]
    if not len(rows):
        return None
    sizes = rows.map(len)
    return fit(matrix(rows[sizes == sizes.mode().max()]), **options)


def encode(vectors: DataFrame, books: Codebooks, beam: int = BEAM) -> DataFrame:
    """``vec_id, code binary, norm float``: the index, one row per vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # books x words x dims numbers
    dims = books.words.shape[2]

    def run(it):
        b = shared.value
        for pdf in it:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                codes, norms = b.encode(b.scaled(matrix(part["v"])), beam)
                yield pd.DataFrame({"vec_id": part["vec_id"], "code": [c.tobytes() for c in codes], "norm": norms})

    return vectors.where(F.size("v") == dims).mapInPandas(run, "vec_id long, code binary, norm float")


_NEAR = "query_id long, vec_id long, estimate double"


class _Nearest:
    """The ``take`` codes nearest to each query of a tile among those met so far, by look-up tables. Codes come by ascending id, so of
    equal estimates those met first stay."""

    def __init__(self, books: Codebooks, take: int):
        m, self.words, d = books.words.shape
        self.books, self.take, self.flat = books, take, books.words.reshape(m * self.words, d)
        self.ids, self.queries, self.far, self.met, self.worst = [], [], [], [], []

    def ask(self, q: pd.DataFrame) -> None:
        self.ids += q["vec_id"].tolist()
        self.queries += list(self.books.scaled(matrix(q["v"])))
        for kept, new in ((self.far, np.zeros(0, np.float32)), (self.met, np.zeros(0, np.int64)), (self.worst, np.inf)):
            kept += [new] * len(q)

    def meet(self, c: pd.DataFrame) -> None:
        ids, norms = c["vec_id"].to_numpy(), c["norm"].to_numpy(np.float32)
        slots = np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), -1).astype(np.int64)
        slots += np.arange(slots.shape[1]) * self.words
        for i, x in enumerate(self.queries):
            table = self.flat @ x  # the look-up table: <query, codeword>
            near = norms - 2 * table[slots].sum(1)
            some = np.flatnonzero((near < self.worst[i]) & (ids != self.ids[i]))
            if len(some):
                far, met = np.concatenate((self.far[i], near[some])), np.concatenate((self.met[i], ids[some]))
                if len(far) > self.take:
                    first = np.argsort(far, kind="stable")[: self.take]
                    far, met = far[first], met[first]
                    self.worst[i] = far[-1]
                self.far[i], self.met[i] = far, met

    def found(self):
        for at in range(0, len(self.ids), 64):
            part = slice(at, at + 64)
            yield pd.DataFrame({"query_id": np.repeat(self.ids[part], [len(x) for x in self.met[part]]), "vec_id": np.concatenate(self.met[part]), "estimate": np.concatenate(self.far[part]).astype(float)})


def _scan(shared, take: int):
    """Tiles one after the other, each with its queries first: a tile's codes pass by and only its queries' nearest are kept."""

    def run(it):
        key = tile = None
        for pdf in it:
            for now, part in pdf.groupby(["tile", "shard"], sort=False):
                if now != key:
                    if tile is not None:
                        yield from tile.found()
                    key, tile = now, _Nearest(shared.value, take)
                stored = part["code"].notna()
                if not stored.all():
                    tile.ask(part[~stored])
                if stored.any() and tile.ids:
                    tile.meet(part[stored])
        if tile is not None:
            yield from tile.found()

    return run


def shortlists(index: DataFrame, asked: DataFrame, books: Codebooks, take: int, n: int, n_asked: int, shard: int = SHARD) -> DataFrame:
    """``query_id, vec_id, estimate``: of each shard of ``index`` the ``take`` codes nearest to each query of ``asked`` (``vec_id, v``)."""
    shards, tiles = max(1, min(SHARDS, -(-n // shard))), max(1, -(-n_asked // QUERY_TILE), min(TILES, n_asked // SMALL_TILE))
    part = lambda seed, of: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    queries = asked.select("vec_id", "v", none("binary").alias("code"), none("float").alias("norm"), part(1, tiles).alias("tile"), every(shards).alias("shard"))
    stored = index.select("vec_id", none(asked.schema["v"].dataType).alias("v"), "code", "norm", part(2, shards).alias("shard"), every(tiles).alias("tile"))
    # twice as many partitions as tiles: fewer of them share one
    met = queries.unionByName(stored).repartition(2 * shards * tiles, "tile", "shard").sortWithinPartitions("tile", "shard", F.col("code").isNotNull(), "vec_id")
    return met.mapInPandas(_scan(index.sparkSession.sparkContext.broadcast(books), take), _NEAR)


def _distances(it):
    for pdf in it:
        for at in range(0, len(pdf), 4096):
            part = pdf.iloc[at : at + 4096]
            far = np.sqrt(((matrix(part["v"]) - matrix(part["q"])) ** 2).sum(1)) if len(part) else np.zeros(0)
            yield pd.DataFrame({"query_id": part["query_id"], "vec_id": part["vec_id"], "score": far})


def search(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", shortlist: int | None = None, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row for which ``is_query`` (over ``vec_id``) holds."""
    spark = df.sparkSession
    vectors = usable_vectors(df, id_col, vec_col)
    books = sample_fit(vectors, sample)
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.where(F.size("v") == books.words.shape[2])
    index = cut(encode(vectors, books))
    asked = cut(vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    n, n_asked = index.count(), asked.count()
    take = shortlist_size(n, k) if shortlist is None else shortlist
    near = shortlists(index, asked, books, take, n, n_asked, shard)
    first = Window.partitionBy("query_id").orderBy("estimate", "vec_id")
    merged = near.withColumn("at", F.row_number().over(first)).where(F.col("at") <= take).select("query_id", "vec_id").distinct()
    both = merged.join(vectors, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    found = both.select("query_id", "vec_id", "v", "q").mapInPandas(_distances, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
