"""Periodic run detection by seeds on diagonals.

A run is a stretch of consecutive words with smallest period q and at least ``max(24, 3 * q)`` words that no neighbouring word
extends. Words q apart are equal along a *diagonal* of lag q, over at least ``length - q`` places, so a run of lag q holds the
same k-gram at a place and q later, where k is the overlap that all lags of a band have at least: 16 words for lags 1 to 8 and
2 * Q for lags from Q to 1.5 * Q. Each band indexes the k-grams of a document (only at places whose shorter k-gram occurs
again), pairs their occurrences within the band, and extends a pair along its diagonal to both sides, unless the table of the
furthest place covered on that lag shows that an earlier extension has been there.

Pairs don't grow with the square of a group: if two of the occurrences from a place to the one q later lie e < q apart and
e + q <= k, the k-gram has both periods, hence their greatest common divisor (Fine and Wilf), which then is a period of the
whole run, so q is not its smallest. Only occurrences further apart matter, and few of those fit in a band.

Documents are independent, so nothing is shuffled. K-grams meet by 64-bit hashes; lags are compared word by word.

Defined results: a null or empty text, or one of blanks, has no words and no runs; its digests are those of the empty string;
a null id never makes its text periodic; repeated rows give the same row each; texts of any length are taken whole; equally
periodic runs go to the smaller start, then the smaller period; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import mix, prefix_hashes, window_hashes

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3


def bands(n: int, least: int = LEAST, times: int = TIMES):
    """(smallest lag, first lag beyond, k) of the bands for texts of ``n`` words: every run of a lag shares a k-gram with itself."""
    low, high = 1, least // times + 1
    while low * times <= n:
        yield low, high, max(least - high + 1, (times - 1) * low)
        low, high = high, max(high + 1, high * 3 // 2)


def seeds(at: np.ndarray, grams: np.ndarray, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, lags) of the occurrence pairs of a band that can start a run, and the places whose k-gram occurs again."""
    order = np.argsort(grams, kind="stable")  # places ascend within a gram
    at, grams = at[order], grams[order]
    same = grams[1:] == grams[:-1]
    again = np.zeros(len(at), bool)
    again[1:] |= same
    again[:-1] |= same
    places, lags = [], []
    first = np.flatnonzero(same)
    gap = np.full(len(first), np.iinfo(np.int64).max)
    step = 1
    while len(first):
        to = first + step
        ok = to < len(at)
        first, gap, to = first[ok], gap[ok], to[ok]
        lag = at[to] - at[first]
        gap = np.minimum(gap, at[to] - at[to - 1])
        ok = (grams[to] == grams[first]) & (lag < high)
        first, gap, lag = first[ok], gap[ok], lag[ok]
        found = (lag >= low) & ((gap == lag) | (gap + lag > k))
        places.append(at[first[found]])
        lags.append(lag[found])
        ok = gap + high > k
        first, gap, step = first[ok], gap[ok], step + 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *lags]), np.sort(at[again])


def agreement(words: np.ndarray, at: int, lag: int, turn: int) -> int:
    """How many places from ``at`` on (``turn`` 1) or before it (-1) agree with those ``lag`` later."""
    n, size, most = 0, 32, len(words) - lag - at if turn == 1 else at
    while n < most:
        size = min(size, most - n)
        a = at + n if turn == 1 else at - n - size
        differ = words[a : a + size] != words[a + lag : a + lag + size]
        if differ.any():
            return n + int(differ.argmax() if turn == 1 else differ[::-1].argmax())
        n, size = n + size, size * 2
    return n


def find_runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs among numbered words, by start, then period."""
    n = len(words)
    if n < least:
        return []
    sums = prefix_hashes(mix(words.astype(np.uint64)))
    at = np.arange(n)
    found: dict[tuple[int, int], int] = {}
    for low, high, k in bands(n, least, times):
        at = at[at <= n - k]
        places, lags, at = seeds(at, window_hashes(sums, at, at + k), low, high, k)
        if not len(at):
            break
        covered: dict[int, int] = {}
        order = np.lexsort((places, lags))
        for i, lag in zip(places[order].tolist(), lags[order].tolist(), strict=True):
            if i < covered.get(lag, 0):
                continue
            end = i + agreement(words, i, lag, 1)
            covered[lag] = max(end, i + 1)
            if end - i >= k:  # else two k-grams of one hash
                start = i - agreement(words, i, lag, -1)
                length = end + lag - start
                if length >= max(least, times * lag):
                    found[start, length] = min(lag, found.get((start, length), lag))
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number among the distinct ones."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def folded(n: int, h: int) -> np.ndarray | None:
    """The original word that stands at each of ``n`` places where crc32 ``h`` of the id makes the text periodic, else None."""
    if n == 0 or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _row(text: str | None, fold: int | None, least: int, times: int) -> tuple:
    words = (text or "").encode("utf-8", "replace").split()  # bytes split at \x20 and \x09-\x0D only
    own = numbered(words)
    moved = None if fold is None else folded(len(words), fold)
    if moved is not None:
        own, words = own[moved], [words[i] for i in moved.tolist()]
    runs = find_runs(own, least, times)
    drop = np.zeros(len(words) + 1, np.int64)
    for s, m, q in runs:
        drop[s + q] += 1
        drop[s + m] -= 1
    if runs:
        words = [w for w, gone in zip(words, np.cumsum(drop)[:-1].tolist(), strict=True) if not gone]
    return len(own), runs, b" ".join(words).decode("utf-8")


def _rows(least: int, times: int, fold: bool):
    def run(it):
        for pdf in it:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                out = []
                for doc, text in zip(part["doc_id"], part["text"], strict=True):
                    n, runs, kept = _row(text, zlib.crc32(doc.encode()) if fold and doc is not None else None, least, times)
                    best = min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=(None,) * 3)
                    out.append((doc, n, len(runs), *best, [x for r in runs for x in r], kept))
                made = pd.DataFrame(out, columns=["doc_id", "n_words", "n_runs", "start", "length", "period", "runs", "collapsed"])
                yield made.astype({c: "Int64" for c in ("start", "length", "period")})

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, fold: bool = False) -> DataFrame:
    """``doc_id, n_words, n_runs, start, length, period, exponent_milli, runs, collapsed``, a row per document.

    ``start``, ``length`` and ``period`` are those of the most periodic run; ``runs`` holds all of them (structs of the three);
    ``collapsed`` is the text without what repeats: every run keeps its first period, words are joined by one blank. With
    ``fold`` the texts of a tenth of the ids are made periodic from some place on first, as a test of recall.
    """
    if times < 3:
        raise ValueError("a run has three periods at least")
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    made = "doc_id string, n_words long, n_runs long, start long, length long, period long, runs array<long>, collapsed string"
    flat = rows.mapInPandas(_rows(least, times, fold), made)
    k = lambda i, j: F.element_at("runs", (i * 3 + j + 1).cast("int"))
    one = lambda i: F.struct(k(i, 0).alias("start"), k(i, 1).alias("length"), k(i, 2).alias("period"))
    runs = F.when(F.col("n_runs") > 0, F.transform(F.sequence(F.lit(0), F.col("n_runs") - 1), one)).otherwise(F.array().cast("array<struct<start:long,length:long,period:long>>"))
    exponent = F.expr("(length * 1000) div period").alias("exponent_milli")
    return flat.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_words", "n_runs", "start", "length", "period", exponent, runs.alias("runs"), "collapsed")


def runs_text(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run."""
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return F.when(F.size(runs) > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
