"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the average of the embeddings of its subwords (byte n-grams of 2 to 4 inside its words, blanks marking word
ends), hashed to a fixed table. Embeddings and softmax are trained together by stochastic gradient descent on a bounded
sample of labelled documents; a held part of the sample sets the temperature and the score below which a prediction is
rejected.

Defined results: a null text or one without a letter is ``und`` with score 0, rejected; rows whose label is null are not
learned from; where an id is repeated, the row with the least label and counts is learned from; without any labelled row every
text is ``und``; equal probabilities go to the first language in alphabetical order; texts of any length are taken whole; an
empty table gives an empty result; repeated rows get the same prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import IS_WORD, LOWER, blobs, mix, prefix_hashes, window_hashes

BUCKETS, DIMS, GRAMS = 1 << 13, 16, (2, 3, 4)
#: The model is fitted on at most so many labelled documents, the first by hash of the doc_id.
SAMPLE = 2000


def subword_counts(texts) -> np.ndarray:
    """len(texts) x BUCKETS: how often each hashed subword occurs, over whole texts."""
    texts = list(texts)
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for parts, owners in blobs(texts):
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        low = LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
        low = np.where(IS_WORD[low] & ~((low >= 48) & (low <= 57)), low, np.uint8(32))
        low = np.concatenate((np.array([32], np.uint8), low))  # text k starts after the blank before it
        prefix = prefix_hashes(low)
        blank = np.concatenate(([0], np.cumsum(low == 32)))
        for n in GRAMS:
            last = len(low) - n + 1
            if last < 1:
                continue
            inner = blank[n - 1 : n - 1 + last] - blank[1 : 1 + last]  # blanks strictly inside the window
            both = (low[:last] == 32) & (low[n - 1 :] == 32)
            at = np.flatnonzero((inner == 0) & ~both)
            slot = (mix(window_hashes(prefix, at, at + n), n) >> np.uint64(64 - 13)).astype(np.int64)
            cuts = np.searchsorted(at, begins)
            for k, owner in enumerate(owners):
                if cuts[k + 1] > cuts[k]:
                    out[owner] += np.bincount(slot[cuts[k] : cuts[k + 1]], minlength=BUCKETS)
    return out


def averaged(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray
    soft: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def folded(self) -> np.ndarray:
        """Embeddings through the softmax layer: the average of these rows is the logit."""
        return self.embed @ self.soft

    def probabilities(self, counts: np.ndarray, folded: np.ndarray | None = None) -> np.ndarray:
        z = (averaged(counts) @ (self.folded() if folded is None else folded) + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(counts: np.ndarray, langs: list[str], epochs: int = 12, rate: float = 0.5, batch: int = 32, seed: int = 7) -> Model:
    """Every fifth row is held for calibration."""
    languages = sorted(set(langs))
    y = np.array([languages.index(x) for x in langs])
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 20 else np.zeros(len(y), bool)
    x, t = averaged(counts)[~held], y[~held]
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    soft = rng.normal(0, 0.3, (DIMS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(len(t)), max(1, len(t) // batch)):
            xb = x[at]
            used = np.flatnonzero(xb.any(0))
            xu = xb[:, used]
            h = xu @ embed[used]
            z = h @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), t[at]] -= 1
            grad_h = p @ soft.T
            soft -= step * (h.T @ p) / len(at) * 8
            bias -= step * p.mean(0)
            embed[used] -= step * (xu.T @ grad_h) * 50
    model = Model(languages, embed, soft, bias)
    if held.any():
        best = (np.inf, 1.0)
        for temperature in (0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
            model.temperature = temperature
            p = model.probabilities(counts[held])
            loss = -np.log(p[np.arange(len(p)), y[held]] + 1e-12).mean()
            best = min(best, (loss, temperature))
        model.temperature = best[1]
        p = model.probabilities(counts[held])
        top, right = p.max(1), p.argmax(1) == y[held]
        # the lowest threshold at which no more than 1 % of the accepted held rows are wrong
        for cut in np.concatenate(([0.0], np.sort(top))):
            if (~right & (top >= cut)).sum() <= 0.01 * max(1, (top >= cut).sum()):
                model.reject_below = float(cut)
                break
        else:
            model.reject_below = 1.0
    return model


def _count_rows(it):
    for pdf in it:
        if len(pdf):
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                counts = subword_counts(part["text"])
                yield pd.DataFrame({"key": part["key"], "lang": part["lang"], "slots": [np.flatnonzero(c).astype(np.int32) for c in counts], "n": [c[c > 0].astype(np.float32) for c in counts]})


def fit(labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on the first ``sample`` labelled rows by hash of the id; only their sparse counts reach the driver."""
    named = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = named.select(F.xxhash64(F.col(id_col)).alias("key")).distinct().orderBy("key").limit(sample)
    rows = (
        named.select(F.xxhash64(F.col(id_col)).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .join(F.broadcast(ids), "key")
        .mapInPandas(_count_rows, "key long, lang string, slots array<int>, n array<float>")
        .groupBy("key")
        .agg(F.min(F.struct("lang", "slots", "n")).alias("v"))  # one row an id leaves the executors
        .select("key", "v.*")
        .toPandas()
        .sort_values("key", kind="stable")
    )
    if not len(rows):
        return None
    counts = np.zeros((len(rows), BUCKETS), np.float32)
    for k, (s, n) in enumerate(zip(rows["slots"], rows["n"], strict=True)):
        counts[k, np.asarray(s, dtype=np.int64)] = n
    return train(counts, rows["lang"].to_list())


def predict(docs: DataFrame, model: Model | None, keep: list[Column] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns (all, by default) with ``lang_pred``, ``score`` and ``rejected``."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")] if keep is None else keep
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    light = Model(model.languages, np.zeros((0, DIMS)), model.soft, model.bias, model.temperature, model.reject_below)
    shared = docs.sparkSession.sparkContext.broadcast((light, model.folded()))  # BUCKETS x languages numbers

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def lang(text: pd.Series) -> pd.DataFrame:
        m, folded = shared.value
        names, scores = [], []
        for at in range(0, len(text), 256):
            part = text.iloc[at : at + 256]
            p = m.probabilities(subword_counts(part), folded)
            for t, row in zip(part, p, strict=True):
                if t is None or not any(map(str.isalpha, t)):
                    names.append("und")
                    scores.append(0.0)
                else:
                    names.append(m.languages[int(row.argmax())])
                    scores.append(float(row.max()))
        return pd.DataFrame({"lang_pred": names, "score": scores, "rejected": [n == "und" or s < m.reject_below for n, s in zip(names, scores, strict=True)]})

    found = docs.select(*keep, lang(F.col(text_col)).alias("_lang_id"))
    kept = [c for c in found.columns if c != "_lang_id"]
    return found.select(*[F.col(f"`{c}`") for c in kept], "_lang_id.lang_pred", "_lang_id.score", "_lang_id.rejected")
