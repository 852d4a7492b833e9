"""Vector code compression: product codes of integers, by k-means with Drake and Hamerly's adaptive bounds.

A vector's components become integers ``floor(SCALE * x)``; it is cut into equal consecutive parts, and each part is coded by
the nearest entry of that part position's codebook (squared Euclidean distance in integers, ties to the lower index). The
codebooks start as the parts of the vectors with the smallest ids; each round assigns all parts and replaces every entry by the
componentwise floor of its parts' mean.

What a vector knows of its distances is kept from round to round (Drake and Hamerly 2012): for each part the b closest other
entries with lower bounds of their distances, in order, and one outer bound for all the rest. When the entries have moved, a
list bound sinks by its entry's way and the outer bound by the longest way; the distance to the part's own entry is computed
anew. Entries whose bound is not above it are verified by exact integer distances; where not even the outer bound is above
it, all entries are, and the list is made anew. b follows the need: it becomes the length that settles all but one in
a hundred parts of the last round. Bounds only save work: the codes are those of the plain computation.

A round is one pass that writes a table (integers, own entries, lists) in place of the one before and one that adds up entries; a
task hands on one row an entry at most, and only the codebooks reach the driver.

Defined results: null vectors, empty ones, and those with null or non-finite components or with integers beyond ``LARGEST`` take
no part; neither do those of another length than the vector with the smallest id, or any if that is no multiple of the parts; rows
that repeat an id are coded each (ties of ids go by the vectors, in order of their components); fewer vectors than entries
give smaller codebooks; entries without parts stay; null labels are one label; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, cut, discard, join_split, store

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers beyond it could overflow a squared distance of 64 bits.
LARGEST = 1 << 26
#: Lengths of the lists of bounds: the first one, and the shortest and longest that the need may ask for.
FIRST, SHORTEST, LONGEST = 16, 2, 64
#: Bounds are compared with room for their rounding.
ROOM = 1e-5

_STATE = "vec_id long, label string, x binary, own binary, near binary, low binary, need binary"


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by entries."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if int(most) ** 2 * 4 * max(1, x.shape[1]) < 1 << 53:  # all sums are exact in doubles
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def _lists(d: np.ndarray, own: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The b closest entries but one's own, and their distances followed by that of the next: lists from full distances."""
    rest = np.sqrt(d.astype(np.float64))
    rest[np.arange(len(d)), own] = np.inf
    b = min(b, d.shape[1] - 1)
    order = np.argsort(rest, axis=1, kind="stable")[:, : b + 1]
    low = np.take_along_axis(rest, order, 1)
    if low.shape[1] == b:
        low = np.concatenate((low, np.full((len(d), 1), np.inf)), 1)
    return order[:, :b], low


def assign_all(x: np.ndarray, entries: np.ndarray, b: int):
    """(own entry, list, bounds with the outer one last, need) from all distances."""
    d = distances(x, entries)
    own = d.argmin(1)
    return own, *_lists(d, own, b), np.full(len(x), 255)


def assign_bounded(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, own: np.ndarray, near: np.ndarray, low: np.ndarray, b: int):
    """The same, from what was known before the entries moved; ``need`` is the list length that settles a part, 255 if none does."""
    rows, size = np.arange(len(x)), near.shape[1]
    low = low - np.concatenate((moved[near], np.full((len(x), 1), moved.max(initial=0.0))), 1)
    mine = ((x - entries[own]) ** 2).sum(1)
    reach = np.sqrt(mine.astype(np.float64))
    reach += ROOM * (1 + reach)
    unsure = low[:, :size] <= reach[:, None]
    need = np.where(unsure.any(1), size - unsure[:, ::-1].argmax(1), 0) if size else np.zeros(len(x), np.int64)
    fresh = low[:, size] <= reach
    # entries of the list that may be nearer, verified in integers
    i, j = np.nonzero(unsure & ~fresh[:, None])
    if len(i):
        other = near[i, j]
        d = ((x[i] - entries[other]) ** 2).sum(1)
        low[i, j] = np.sqrt(d.astype(np.float64))
        # the best of a part: least distance, then least index
        order = np.lexsort((other, d, i))
        top = order[np.concatenate(([True], i[order][1:] != i[order][:-1]))]
        p, q, o, far = i[top], j[top], other[top], d[top]
        won = (far < mine[p]) | ((far == mine[p]) & (o < own[p]))
        p, q, o = p[won], q[won], o[won]
        near[p, q], low[p, q] = own[p], np.sqrt(mine[p].astype(np.float64))
        own[p] = o
    need[fresh] = 255
    # in order again; a shorter list hands its tail to the outer bound
    order = np.argsort(low[:, :size], axis=1, kind="stable")
    near, inner = np.take_along_axis(near, order, 1), np.take_along_axis(low[:, :size], order, 1)
    keep = min(b, size)
    outer = np.minimum(low[:, size], inner[:, keep]) if keep < size else low[:, size]
    wide = min(b, len(entries) - 1)
    out_near, out_low = np.zeros((len(x), wide), np.int64), np.full((len(x), wide + 1), np.inf)
    out_near[:, :keep], out_low[:, :keep], out_low[:, wide] = near[:, :keep], inner[:, :keep], outer
    if keep < wide:  # a list may grow only where it is made anew: until then its places are the first entry, never nearer than the outer bound
        out_low[:, keep:wide] = outer[:, None]
    at = rows[fresh]
    if len(at):
        own[at], out_near[at], out_low[at], _ = assign_all(x[at], entries, b)
    return own, out_near, out_low, need


def _assign(shared, b: int, before: int | None):
    """Codes and bounds of a batch by the codebooks of ``shared``; ``before`` is the length of the lists it comes with."""

    def run(it):
        books, moved = shared.value
        parts, dims = len(books), books[0].shape[1]
        for pdf in it:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                n = len(part)
                x = np.frombuffer(b"".join(part["x"]), np.int32).reshape(n, parts, dims).astype(np.int64)
                if before is not None:
                    own = np.frombuffer(b"".join(part["own"]), np.uint8).reshape(n, parts).astype(np.int64)
                    near = np.frombuffer(b"".join(part["near"]), np.uint8).reshape(n, parts, before).astype(np.int64)
                    low = np.frombuffer(b"".join(part["low"]), np.float32).reshape(n, parts, before + 1).astype(np.float64)
                found = [
                    assign_all(x[:, p], books[p], b) if before is None else assign_bounded(x[:, p], books[p], moved[p], own[:, p].copy(), near[:, p].copy(), low[:, p], b)
                    for p in range(parts)
                ]
                column = lambda k, kind: [r.tobytes() for r in np.stack([f[k] for f in found], 1).astype(kind)]  # noqa: E731, B023
                # a bound may only be rounded down
                lows = np.stack([f[2] for f in found], 1)
                yield pd.DataFrame({
                    "vec_id": part["vec_id"], "label": part["label"], "x": part["x"], "own": column(0, np.uint8), "near": column(1, np.uint8),
                    "low": [r.tobytes() for r in np.nextafter(lows.astype(np.float32), np.float32(-np.inf))], "need": column(3, np.uint8),
                })

    return run


def _sums(parts: int, entries: int, dims: int):
    """Sums and counts of the parts by entry, and counts of the needs (``entry`` below 0): a few rows a task."""

    def run(it):
        total, count, needs = np.zeros((parts, entries, dims), np.int64), np.zeros((parts, entries), np.int64), np.zeros((parts, 256), np.int64)
        for pdf in it:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                x = np.frombuffer(b"".join(part["x"]), np.int32).reshape(len(part), parts, dims).astype(np.int64)
                own = np.frombuffer(b"".join(part["own"]), np.uint8).reshape(len(part), parts)
                need = np.frombuffer(b"".join(part["need"]), np.uint8).reshape(len(part), parts)
                for p in range(parts):
                    np.add.at(total[p], own[:, p], x[:, p])
                    count[p] += np.bincount(own[:, p], minlength=entries)
                    needs[p] += np.bincount(need[:, p], minlength=256)
        p, e = np.nonzero(count)
        q, k = np.nonzero(needs)
        yield pd.DataFrame({
            "part": np.concatenate((p, q)).astype(np.int32), "entry": np.concatenate((e, -1 - k)).astype(np.int32), "n": np.concatenate((count[p, e], needs[q, k])),
            "total": pd.Series([*total[p, e].tolist(), *([] for _ in q)], dtype=object),
        })

    return run


def next_length(needs: np.ndarray, b: int) -> int:
    """The list length that settles all but a hundredth of the parts (needs by length, 255 for those that no list settled)."""
    counts = needs.sum(0)
    over = counts.sum() - np.cumsum(counts)
    enough = np.flatnonzero(over[:b] * 100 <= counts.sum())
    return max(SHORTEST, int(enough[0])) if len(enough) else min(LONGEST, 2 * b)


def _integers(it):
    for pdf in it:
        for at in range(0, len(pdf), 1024):
            part = pdf.iloc[at : at + 1024]
            x = np.floor(SCALE * np.array(part["v"].tolist(), np.float64)).astype(np.int32)
            yield pd.DataFrame({"vec_id": part["vec_id"], "label": part["label"], "x": [r.tobytes() for r in x]})


def usable_rows(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``vec_id, label string, v array<double>`` of the rows that take part (zero vectors do)."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST / SCALE))
    rows = df.where(F.coalesce(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~bad, F.lit(False)) & F.col(id_col).isNotNull())
    label = F.when(F.col(label_col).isNotNull(), F.concat(F.lit("="), F.col(label_col).cast("string"))).otherwise("null")
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))


def _errors(shared):
    def run(it):
        books = shared.value[0]
        parts, dims = len(books), books[0].shape[1]
        for pdf in it:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                x = np.frombuffer(b"".join(part["x"]), np.int32).reshape(len(part), parts, dims).astype(np.int64)
                own = np.frombuffer(b"".join(part["own"]), np.uint8).reshape(len(part), parts)
                far = sum(((x[:, p] - books[p][own[:, p]]) ** 2).sum(1) for p in range(parts)) if len(part) else np.zeros(0, np.int64)
                yield pd.DataFrame({"vec_id": part["vec_id"], "label": part["label"], "code": [r.tobytes().hex() for r in own], "error": far})

    return run


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(``vec_id, label, code, error``, codebooks): labels as strings with a mark, codes as two hex digits a part."""
    spark = df.sparkSession
    rows = usable_rows(df, id_col, vec_col, label_col)
    first = rows.orderBy("vec_id", "v").limit(entries).select("v").collect()  # as many vectors as a codebook has entries
    size = len(first[0]["v"]) if first else 0
    if not size or size % parts:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long"), []
    rows = rows.where(F.size("v") == size)
    first = rows.orderBy("vec_id", "v").limit(entries).select("v").collect() if any(len(r["v"]) != size for r in first) else first
    start = np.floor(SCALE * np.array([r["v"] for r in first], np.float64)).astype(np.int64)
    books = [start[:, p * (size // parts) : (p + 1) * (size // parts)] for p in range(parts)]
    moved = [np.zeros(len(start)) for _ in books]
    state, path = store(rows.mapInPandas(_integers, "vec_id long, label string, x binary"))
    b, before = min(FIRST, len(start) - 1), None
    for round_ in range(rounds + 1):
        shared = spark.sparkContext.broadcast((books, moved))  # parts x entries vectors
        wide = min(b, len(start) - 1)
        old, (state, path) = path, store(state.mapInPandas(_assign(shared, wide, before), _STATE))
        discard(spark, old)
        before = wide
        if round_ == rounds:
            break
        shared.unpersist()
        added = state.select("x", "own", "need").mapInPandas(_sums(parts, len(start), size // parts), "part int, entry int, n long, total array<long>")
        at = [F.sum(F.get("total", F.lit(k))).alias(f"t{k}") for k in range(size // parts)]
        needs, now = np.zeros((parts, 256), np.int64), [x.copy() for x in books]
        for r in added.groupBy("part", "entry").agg(F.sum("n").alias("n"), *at).collect():  # parts x (entries + 256) rows at most
            if r["entry"] < 0:
                needs[r["part"], -1 - r["entry"]] = r["n"]
            else:
                now[r["part"]][r["entry"]] = [r[f"t{k}"] // r["n"] for k in range(size // parts)]
        moved = [np.sqrt(((x - y) ** 2).sum(1).astype(np.float64)) * (1 + 1e-12) for x, y in zip(books, now, strict=True)]
        books = now
        b = b if round_ == 0 else next_length(needs, before)
    coded = cut(state.select("vec_id", "label", "x", "own").mapInPandas(_errors(shared), "vec_id long, label string, code string, error long"))
    discard(spark, path)
    shared.unpersist()
    return coded, books


def codebooks_text(books: list[np.ndarray]) -> str:
    """All entries' components in decimal, by part, entry and place."""
    return ",".join(str(c) for book in books for c in book.reshape(-1).tolist())


def codes(df: DataFrame, **options) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``, one row per vector that takes part."""
    coded, books = compress(df, **options)
    labels = cut(coded.groupBy("label").agg(F.sum("error").cast("long").alias("label_error"), F.count("*").alias("rows")))
    hot = cut(labels.where(F.col("rows") > coded.count() / HOT).select("label"))
    both = join_split(coded, labels.select("label", "label_error"), "label", hot)
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
