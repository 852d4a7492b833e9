"""Quality classifier by co-training: a text view and a metadata view teach each other, then score together.

Two logistic models see disjoint views of a page: its whole text (byte histogram and surface statistics) and its
metadata (language, source, stated length). Over several rounds each scores all unlabelled documents on the executors and
labels those it is most sure of for the other; both are then calibrated on labelled documents that took no part in
training, and their calibrated log odds are added to score every document.

The views of all documents are worked out once and kept as a table for the rounds. The driver gets the views of the labelled
sample and of the few documents picked in a round, nothing that grows with the corpus.

Defined results: null and empty texts have the all-zero text view; null metadata is a category of its own; labels that
are null are left out, several labels of one document are averaged and rounded up; where the labels don't hold both
classes every document scores 0.5 and is kept; an empty table gives an empty result; repeated rows score alike; where an
id is repeated with other texts, the row whose view comes first in byte order trains; equal confidences go to the smaller
id; texts of any length are taken whole; columns named like the new ones are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, store
from .hashing import LOWER, pieces, word_hashes

#: The fit uses at most so many labelled documents, the first by hash of the doc_id.
LABELLED = 6000
#: Rounds of co-training, and documents that each view labels for the other in a round; picked from all unlabelled ones.
ROUNDS, PER_ROUND = 3, 600
SOURCES = 32
TEXT_DIMS, META_DIMS = 256 + 10, 8 + SOURCES + 3


def text_view(texts) -> np.ndarray:
    """One row per text: square-root byte frequencies and ten surface statistics, over the whole text."""
    texts = list(texts)
    out = np.zeros((len(texts), TEXT_DIMS), np.float32)
    words, bounds = word_hashes(texts)
    for k, t in enumerate(texts):
        if not t:
            continue
        n, hist, lines, runs = 0, np.zeros(256), 0, np.zeros(3)
        for part in pieces(t):
            b = np.frombuffer(part, np.uint8)
            if not len(b):
                continue
            n += len(b)
            hist += np.bincount(b, minlength=256)
            lines += int((b == 10).sum())
            punct = (b < 128) & (b > 32) & ~((b >= 48) & (b <= 57)) & ~((LOWER[b] >= 97) & (LOWER[b] <= 122))
            same = b[1:] == b[:-1]
            runs += (same & punct[1:]).sum(), same.sum(), (punct[1:] & punct[:-1]).sum()
        w = words[bounds[k] : bounds[k + 1]]
        letters = max(1.0, hist[65:91].sum() + hist[97:123].sum())
        out[k, :256] = np.sqrt(hist / n)
        out[k, 256:] = (
            np.log1p(n) / 10, np.log1p(len(w)) / 10, len(np.unique(w)) / max(1, len(w)), min(2.0, n / max(1, len(w)) / 10),
            hist[65:91].sum() / letters, lines / max(1, len(w)), *(np.sqrt(runs / n)), float(len(w) < 20),
        )
    return out


def meta_view(lang, source, n_chars) -> np.ndarray:
    """One row per page: hashed language and source, stated length; nothing from the text."""
    out = np.zeros((len(lang), META_DIMS), np.float32)
    for k, (a, b, c) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[k, zlib.crc32(str(a).encode()) % 8] = 1
        out[k, 8 + zlib.crc32(str(b).encode()) % SOURCES] = 1
        if c is not None and c == c:
            n = np.log1p(max(0.0, float(c)))
            out[k, -3:] = n / 10, float(n < 5), 0
        else:
            out[k, -1] = 1
    return out


@dataclass
class Logistic:
    """Logistic regression on standardised features, by full-batch gradient descent with momentum."""

    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    b: float = 0.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    std: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0
    shift: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, l2: float = 1e-3) -> Logistic:
        x = x.astype(np.float32)
        self.mean, self.std = x.mean(0), x.std(0)
        self.std[self.std < 1e-6] = np.inf  # constant features carry nothing
        z = ((x - self.mean) / self.std).astype(np.float32)
        w, b, vw, vb = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0
        weight = weight / weight.sum()
        rate = 0.5
        for _ in range(steps):
            g = weight * (1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y)
            vw = 0.9 * vw - rate * (z.T @ g + l2 * w)
            vb = 0.9 * vb - rate * g.sum()
            w, b = w + vw, b + vb
        self.w, self.b = w, b
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.std) @ self.w + self.b, -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling with smoothed targets."""
        f = self.raw(x)
        n1, n0 = y.sum(), len(y) - y.sum()
        t = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, c = 1.0, 0.0
        for _ in range(50):  # Newton's method, damped
            p = 1 / (1 + np.exp(-np.clip(a * f + c, -30, 30)))
            r, h = p - t, p * (1 - p) + 1e-6
            g = np.array([(r * f).mean() + 1e-3 * a, r.mean()])
            hess = np.array([[(h * f * f).mean() + 1e-3, (h * f).mean()], [(h * f).mean(), h.mean() + 1e-6]])
            step = np.linalg.solve(hess, g)
            a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
        self.scale, self.shift = float(max(a, 0.0)), float(c)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.scale * self.raw(x) + self.shift


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Calibrated log odds of the views added; their shared prior counts once."""
        z = self.text.logit(text) + self.meta.logit(meta) - self.prior
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


Picks = dict[str, tuple[np.ndarray, np.ndarray]]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pick: Callable[[dict[str, Logistic], float], Picks], rounds: int = ROUNDS) -> CoTrained | None:
    """Every fourth labelled row calibrates and takes no part in training; None if either part lacks a class.

    ``pick`` gets both models and the share of good documents, and returns for each view the rows that the other one is surest
    of, with their labels.
    """
    cal = np.arange(len(y)) % 4 == 3
    if min((y[~cal] == c).sum() for c in (0, 1)) < 2 or min((y[cal] == c).sum() for c in (0, 1)) < 1:
        return None
    rate = float(y[~cal].mean())
    sets = {"text": ([text[~cal]], [y[~cal]], [np.ones((~cal).sum())]), "meta": ([meta[~cal]], [y[~cal]], [np.ones((~cal).sum())])}

    def train() -> dict[str, Logistic]:
        return {name: Logistic().fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws)) for name, (xs, ys, ws) in sets.items()}

    models = train()
    for _ in range(rounds):
        picks = pick(models, rate)
        if not any(len(labels) for _, labels in picks.values()):
            break
        for pupil, (x, labels) in picks.items():
            xs, ys, ws = sets[pupil]
            xs.append(x)
            ys.append(labels)
            ws.append(np.full(len(labels), 0.5))
        models = train()
    models["text"].calibrate(text[cal], y[cal])
    models["meta"].calibrate(meta[cal], y[cal])
    p = (y[cal].sum() + 1) / (cal.sum() + 2)
    return CoTrained(models["text"], models["meta"], float(np.log(p / (1 - p))))


def _featurise(it):
    for pdf in it:
        for at in range(0, len(pdf), 256):
            part = pdf.iloc[at : at + 256]
            t, m = text_view(part["text"]), meta_view(part["lang"], part["source"], part["n_chars"])
            yield pd.DataFrame({"i": part["i"], "t": [x.tobytes() for x in t], "m": [x.tobytes() for x in m]})


def _views(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1)


def _picker(features: DataFrame, labelled: DataFrame, per_round: int):
    """Scores all unlabelled documents by both models and brings the surest ones' views, each document once a view."""
    spark, kind = features.sparkSession, dict(features.dtypes)["i"]
    taken: dict[str, list] = {"text": [], "meta": []}

    def pick(models: dict[str, Logistic], rate: float) -> Picks:
        shared = spark.sparkContext.broadcast(models)  # two vectors of weights

        def score(it):
            for pdf in it:
                for at in range(0, len(pdf), 1024):
                    part = pdf.iloc[at : at + 1024]
                    yield pd.DataFrame({"i": part["i"], "text": shared.value["text"].raw(_views(part["t"])), "meta": shared.value["meta"].raw(_views(part["m"]))})

        scored, path = store(features.mapInPandas(score, f"i {kind}, text double, meta double").join(labelled.select("i"), "i", "left_anti"))
        chosen = None
        for teacher, pupil in (("text", "meta"), ("meta", "text")):
            gone = spark.createDataFrame([(i,) for i in taken[pupil]], f"i {kind}")  # at most rounds x per_round ids
            free = scored.join(F.broadcast(gone), "i", "left_anti").select("i", F.col(teacher).alias("z"))
            for label, n, side in ((0.0, int(per_round * (1 - rate)), F.col("z") < -2), (1.0, int(per_round * rate), F.col("z") > 2)):
                best = free.where(side).orderBy(F.col("z") if label == 0 else -F.col("z"), "i").limit(n)
                best = best.select("i", F.lit(pupil).alias("pupil"), F.lit(label).alias("y"))
                chosen = best if chosen is None else chosen.unionByName(best)
        # one row an id and view leaves the executors, however often the id is repeated
        best = features.join(F.broadcast(chosen.distinct()), "i").groupBy("i", "pupil", "y").agg(F.min(F.struct("t", "m")).alias("v"))
        rows = best.select("i", "pupil", "y", "v.t", "v.m").toPandas().sort_values("i", kind="stable")
        shared.destroy()
        discard(spark, path)
        out = {}
        for pupil, view in (("meta", "m"), ("text", "t")):
            own = rows[rows["pupil"] == pupil]
            taken[pupil] += own["i"].to_list()
            out[pupil] = (_views(own[view]) if len(own) else np.zeros((0, TEXT_DIMS if view == "t" else META_DIMS), np.float32), own["y"].to_numpy(dtype=float))
        return out

    return pick


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> CoTrained | None:
    """Fit on a bounded sample of the labelled documents and on picks from all unlabelled ones."""
    lab = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    lab = lab.groupBy(F.col("doc_id").alias("i")).agg(F.when(F.avg(label_col) >= 0.5, 1.0).otherwise(0.0).alias("y"))
    picked = lab.orderBy(F.xxhash64("i"), "i").limit(labelled)
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("i"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars"))
    features, path = store(rows.mapInPandas(_featurise, f"i {dict(docs.dtypes)['doc_id']}, t binary, m binary"))
    try:
        one = features.join(F.broadcast(picked), "i").groupBy("i", "y").agg(F.min(F.struct("t", "m")).alias("v"))
        known = one.select(F.xxhash64("i").alias("key"), "i", "y", "v.t", "v.m").toPandas().sort_values(["key", "i"], kind="stable")  # at most ``labelled`` rows
        if not len(known):
            return None
        return co_train(_views(known["t"]), _views(known["m"]), known["y"].to_numpy(), _picker(features, lab, per_round), rounds)
    finally:
        discard(docs.sparkSession, path)


def score_column(model: CoTrained | None, docs: DataFrame):
    """The calibrated probability of good quality, as a column over ``docs``."""
    if model is None:
        return F.lit(0.5)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        found = [np.zeros(0)]
        for at in range(0, len(text), 256):
            part = slice(at, at + 256)
            found.append(shared.value.score(text_view(text.iloc[part]), meta_view(lang.iloc[part], source.iloc[part], n_chars.iloc[part])))
        return pd.Series(np.concatenate(found), dtype="float64")

    return score(F.col("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("double"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit_options) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1) and ``quality_kept``."""
    model = fit(docs, labels, **fit_options)
    scored = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("quality_score", "quality_kept")], score_column(model, docs).alias("quality_score"))
    return scored.withColumn("quality_kept", F.col("quality_score") >= threshold)
