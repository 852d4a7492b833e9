"""Toxicity by weak supervision: many voters, a label model of their accuracies and correlations, and a linear classifier.

Voters look at a text only. Some are lexicons: a short general one, and one for each word stem that labelled training texts show
to be toxic. A stem is a word's beginning that is telling where it occurs at all, or only where it occurs for the third time; it
votes from that count on, and again from two more. Others are patterns: how many hits there are, how dense and how varied,
insults that address the reader, shouting; and some vote for clean. A voter fires or abstains, in one direction. Documents of
the sample that share the least of their five-word shingles are copies of each other and weigh as one.

The label model is generative: given the hidden label, voter j fires with a probability of its own, whose odds follow from its
accuracy (the share of its firings that are right). EM over the votes of all training documents, labelled or not, estimates the
accuracies, held near those seen on labelled ones in proportion to their number. Voters that fire together more often than
their accuracies explain are correlated: the residual correlations given the label are measured in one pass, and each voter
counts as the share of a vote that its correlated group leaves it. The posterior labels of the sample train a logistic
classifier on counts; held labels calibrate it, so that a score is a probability.

Bounds: stems are mined from, and the classifier is fitted on, at most ``PER_CLASS`` labelled documents of each class, the first by
hash of the id; the classes are weighted back to their shares. The label model reads all training documents: each pass
hands on sums a task, and the driver gets a row a voter. No row leaves its partition but those sums.

Defined results: null and empty texts have no hits and get a score like any text without hits; null ids train as unlabelled
documents and are scored; null labels are left out, several labels of one document are averaged and rounded up; where an id
repeats with other texts, the text with the smallest hash is the one that trains; without both classes among the labels only
the general lexicon and the patterns vote, with stated accuracies; repeated rows get the same score; texts of any length are
taken whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import string
from collections import Counter as Bag
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, store
from .hashing import IS_WORD, LOWER, blobs, mix, prefix_hashes, window_hashes, word_hashes
from .quality import Logistic

#: The fit sees at most so many labelled documents of each class, the first by hash of the id.
PER_CLASS = 3000
#: Stems that vote, and characters of a stem.
STEMS, SHORTEST, LONGEST = 64, 3, 10
#: Counts from which a stem can tell.
LEVELS = (1, 2, 3)
#: A stem must be so many times as frequent in toxic documents, with so large a likelihood ratio (twice its logarithm).
LIFT, EVIDENCE = 4.0, 22.0
#: EM passes before and after the correlations are known.
PASSES = (4, 3)
#: Accuracy of voters of which no labelled firing is known, and the labelled firings that weigh as much as the EM estimate.
GUESS, TRUST = 0.8, 20.0
THRESHOLD = 0.7
#: General words of abuse, in the languages the corpus is likely to hold.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "jerk",
    "bastard", "vermin", "filth", "dummkopf", "trottel", "abschaum", "arschloch", "imbécile", "crétin", "connard", "ordure", "estúpido", "imbécil", "basura", "idiota", "escoria",
)
_ADDRESS = ("you", "your", "youre", "ur")
_WORD, _LOWER = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_EXTRA = ("words", "lexicon", "address", "shout", "bangs")


def _hashes(words) -> np.ndarray:
    """Sorted hashes of words (or stems) of one byte length, and where each stands."""
    found = [prefix_hashes(np.frombuffer(w, np.uint8)) for w in words]
    return np.array([window_hashes(p, slice(0, 1), slice(len(p) - 1, len(p)))[0] for p in found], np.uint64)


Stem = tuple[bytes, int]  # and the count from which it tells


class Counter:
    """Counts the stems and patterns of whole batches of texts."""

    def __init__(self, found: list[Stem]):
        stems = [s for s, _ in found]
        self.size = len(stems)
        self.tables = []
        for n in sorted({len(s) for s in stems}):
            own = np.array([k for k, s in enumerate(stems) if len(s) == n])
            keys = _hashes([stems[k] for k in own])
            order = np.argsort(keys)
            self.tables.append((n, keys[order], own[order]))
        self.lexicon = np.sort(_hashes([w.encode() for w in LEXICON]))
        self.address = np.sort(_hashes([w.encode() for w in _ADDRESS]))

    @staticmethod
    def _in(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h, at

    def count(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(texts x stems, texts x extras): how often words begin with each stem; words, lexicon words that are no stem's, address, capitals' share, !s."""
        texts = list(texts)
        stems, extra = np.zeros((len(texts), self.size), np.int64), np.zeros((len(texts), len(_EXTRA)))
        letters = np.zeros((len(texts), 2))
        for parts, owners in blobs(texts):
            raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
            low = LOWER[raw]
            word = IS_WORD[low]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], word.astype(np.int8), [0]))))
            starts, ends = edges[0::2], edges[1::2]
            begins = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
            own = np.asarray(owners)
            owner = own[np.searchsorted(begins, starts, "right") - 1]
            sums = prefix_hashes(low)
            hit = np.zeros(len(starts), bool)
            for n, keys, which in self.tables:
                long = np.flatnonzero(ends - starts >= n)
                ok, at = self._in(keys, window_hashes(sums, starts[long], starts[long] + n))
                np.add.at(stems, (owner[long[ok]], which[at[ok]]), 1)
                hit[long[ok]] = True
            full = window_hashes(sums, starts, ends)
            listed = self._in(self.lexicon, full)[0] & ~hit
            hit |= listed
            called = self._in(self.address, full)[0]
            near = np.zeros(len(starts), bool)  # an insult at most four words after its address
            for k in range(1, 5):
                near[k:] |= called[:-k] & (owner[k:] == owner[:-k]) if len(starts) > k else False
            n = len(texts)
            extra[:, 0] += np.bincount(owner, minlength=n)
            extra[:, 1] += np.bincount(owner[listed], minlength=n)
            extra[:, 2] += np.bincount(owner[hit & near], minlength=n)
            for column, at in ((letters[:, 0], (raw >= 65) & (raw <= 90)), (letters[:, 1], (low >= 97) & (low <= 122)), (extra[:, 4], raw == 33)):
                where = np.flatnonzero(at)
                column += np.bincount(own[np.searchsorted(begins, where, "right") - 1], minlength=n)
        extra[:, 3] = np.where(letters[:, 1] >= 40, letters[:, 0] / np.maximum(letters[:, 1], 1), 0)
        return stems, extra


def spared(found: list[Stem]) -> np.ndarray:
    """Occurrences of each stem that don't tell yet."""
    return np.array([n - 1 for _, n in found], np.int64)


def votes(stems: np.ndarray, extra: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x voters: who fires, each voter's direction 1 or -1)."""
    stems = np.maximum(stems - spare, 0)
    words, listed, address, shout, bangs = extra.T
    total, kinds = stems.sum(1) + listed, (stems > 0).sum(1)
    rate = total / np.maximum(words, 1)
    toxic = [total >= 2, total >= 4, total >= 8, rate >= 0.005, rate >= 0.02, rate >= 0.06, kinds >= 2, kinds >= 4, listed >= 1, listed >= 3, address >= 1, shout >= 0.5, bangs >= 3]
    clean = [total == 0, (total == 0) & (words >= 100), rate < 0.001, (total < 2) & (words >= 200)]
    fired = np.concatenate((stems >= 1, stems >= 3, np.stack(toxic, 1), np.stack(clean, 1)), 1)
    return fired, np.concatenate((np.ones(fired.shape[1] - len(clean)), -np.ones(len(clean))))


def features(raw: np.ndarray, extra: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """What the classifier sees: counts that tell, and densities of all."""
    words, listed, address, shout, bangs = extra.T
    stems = np.maximum(raw - spare, 0)
    total = stems.sum(1) + listed
    per = np.maximum(words, 20)
    own = [np.log1p(total), np.sqrt(np.minimum(total / per, 0.25)), np.sqrt(np.minimum((raw.sum(1) + listed) / per, 0.25)), (stems > 0).sum(1), total > 0, total >= 2, np.log1p(listed), np.log1p(address), shout, np.minimum(bangs / per, 1)]
    return np.concatenate((np.log1p(stems), np.sqrt(np.minimum(raw / per[:, None], 0.25)), np.stack(own, 1)), 1).astype(np.float32)


@dataclass
class LabelModel:
    """``right``: the share of each voter's firings where its direction is the label; ``share``: what it counts in its group."""

    direction: np.ndarray
    right: np.ndarray
    prior: float
    spare: np.ndarray
    share: np.ndarray = field(default_factory=lambda: np.ones(0))

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        toxic = np.clip(np.where(self.direction > 0, self.right, 1 - self.right), 0.005, 0.995)
        base = np.log(self.prior / (1 - self.prior))
        z = base + fired @ (self.share * (np.log(toxic / (1 - toxic)) - base))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _counts(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _matrix(part["stems"], np.uint16).astype(np.int64), _matrix(part["extra"], np.float32).astype(float)


def _expect(shared):
    """Sums of a pass of EM, a row a voter and task: firings, and firings weighted by the posterior of toxicity."""

    def run(it):
        model = shared.value
        fired = toxic = np.zeros(len(model.direction))
        for pdf in it:
            for at in range(0, len(pdf), 2048):
                own = votes(*_counts(pdf.iloc[at : at + 2048]), model.spare)[0].astype(float)
                fired, toxic = fired + own.sum(0), toxic + model.posterior(own) @ own
        at = np.flatnonzero(fired)
        yield pd.DataFrame({"voter": at.astype(np.int32), "fired": fired[at], "toxic": toxic[at]})

    return run


def _residuals(shared):
    """Sums of products of residuals given the posterior, for pairs of voters of one direction that fire together."""

    def run(it):
        model, rate1, rate0 = shared.value
        total = np.zeros((len(rate1), len(rate1)))
        for pdf in it:
            for at in range(0, len(pdf), 2048):
                own = votes(*_counts(pdf.iloc[at : at + 2048]), model.spare)[0].astype(float)
                p = model.posterior(own)[:, None]
                rest = own - p * rate1 - (1 - p) * rate0
                total += rest.T @ rest
        i, j = np.nonzero(np.triu(total > 0) & (np.outer(model.direction, model.direction) > 0))
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "c": total[i, j]})

    return run


def correlated_share(cov: np.ndarray, floor: float = 0.05) -> np.ndarray:
    """What each voter counts: one over the sum of its positive correlations with all (its own is 1)."""
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    rho = cov / np.outer(sd, sd)
    rho = np.where(rho > floor, np.minimum(rho, 1), 0)
    np.fill_diagonal(rho, 1)
    return 1 / rho.sum(1)


def fit_label_model(table: DataFrame, direction: np.ndarray, prior: float, spare: np.ndarray, seen: np.ndarray, right: np.ndarray) -> LabelModel:
    """EM over the rows of ``table`` (``stems, extra``). ``seen``: labelled firings of each voter, ``right``: the share right of them."""
    spark = table.sparkSession
    trust = seen / (seen + TRUST)
    model = LabelModel(direction, np.where(seen > 0, (right * seen + GUESS) / (seen + 1), GUESS), prior, spare, np.ones(len(direction)) / 3)
    anchor = model.right
    fired = toxic = np.zeros(len(direction))

    def passes(n: int) -> None:
        nonlocal fired, toxic
        for _ in range(n):
            shared = spark.sparkContext.broadcast(model)  # a few numbers a voter
            rows = table.select("stems", "extra").mapInPandas(_expect(shared), "voter int, fired double, toxic double").groupBy("voter").agg(F.sum("fired"), F.sum("toxic")).collect()  # a row a voter
            shared.destroy()
            fired, toxic = np.zeros(len(direction)), np.zeros(len(direction))
            for voter, n_fired, n_toxic in rows:
                fired[voter], toxic[voter] = n_fired, n_toxic
            own = np.where(direction > 0, toxic, fired - toxic)
            model.right = trust * anchor + (1 - trust) * (own + 1) / (fired + 2)

    passes(PASSES[0])
    if not fired.any():
        return model
    # how often a voter fires among toxic and clean documents follows from its firings and the prior
    n = table.count()
    rate1, rate0 = np.minimum(toxic / max(n * prior, 1), 1), np.minimum((fired - toxic) / max(n * (1 - prior), 1), 1)
    shared = spark.sparkContext.broadcast((model, rate1, rate0))
    cov = np.zeros((len(direction), len(direction)))
    for i, j, c in table.select("stems", "extra").mapInPandas(_residuals(shared), "i int, j int, c double").groupBy("i", "j").agg(F.sum("c")).collect():  # a row a pair of voters
        cov[i, j] = cov[j, i] = c
    shared.destroy()
    model.share = correlated_share(cov)
    passes(PASSES[1])
    return model


def _beginnings(it):
    """How much weight of toxic and clean documents shows each stem once, and three times; a row a stem and batch."""
    for pdf in it:
        for at in range(0, len(pdf), 128):
            found: dict[tuple[str, int], list[float]] = {}
            for y, w, text in zip(*(pdf[c].iloc[at : at + 128] for c in ("y", "weight", "text")), strict=True):
                own = Bag()
                for word, n in Bag(_WORD.findall((text or "").translate(_LOWER))).items():
                    for k in range(SHORTEST, min(len(word), LONGEST) + 1):
                        own[word[:k]] += n
                for stem, n in own.items():
                    for level in LEVELS:
                        if n >= level:
                            found.setdefault((stem, level), [0.0, 0.0])[0 if y > 0.5 else 1] += w
            yield pd.DataFrame([(s, n, *v) for (s, n), v in found.items()], columns=["stem", "level", "a", "b"])


def _incidence(shared):
    def run(it):
        counter, spare = Counter(shared.value), spared(shared.value)
        for pdf in it:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                yield pd.DataFrame({"y": part["y"], "weight": part["weight"], "hits": [r.tobytes() for r in np.packbits(counter.count(part["text"])[0] > spare, axis=1)]})

    return run


def mine_stems(sample: DataFrame, toxic: float, clean: float, most: int = STEMS) -> list[Stem]:
    """Word beginnings that toxic documents of ``sample`` (``y, weight, text``) show far more often: greedily those that bring most
    toxic documents to two stems each. None begins another."""
    n = sample.mapInPandas(_beginnings, "stem string, level int, a double, b double").groupBy("stem", "level").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    part = toxic / (toxic + clean)
    term = lambda k, share: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / ((F.col("a") + F.col("b")) * share))).otherwise(0.0)
    ranked = n.where((F.col("a") >= 3) & (F.col("a") / toxic > LIFT * F.col("b") / clean)).withColumn("g", 2 * (term("a", part) + term("b", 1 - part))).where(F.col("g") >= EVIDENCE)
    best = ranked.orderBy(F.desc("g"), F.desc(F.length("stem")), "stem", "level").limit(20 * most).select("stem", "level", "a", "b").collect()
    told = {}  # the count from which a stem tells best
    for r in sorted(best, key=lambda r: r["level"]):
        worth = r["a"] / toxic - LIFT * r["b"] / clean
        if worth > told.get(r["stem"], (0.0, 0))[0] * 1.02:
            told[r["stem"]] = (worth, r["level"])
    words = [(r["stem"], r["level"]) for r in best if told.get(r["stem"], (0, 0))[1] == r["level"]]
    if not words:
        return []
    shared = sample.sparkSession.sparkContext.broadcast([(s.encode(), k) for s, k in words])
    seen = sample.select("y", "weight", "text").mapInPandas(_incidence(shared), "y double, weight double, hits binary").toPandas()  # a few bits for each row of the sample
    hits = np.unpackbits(_matrix(seen["hits"], np.uint8), axis=1, count=len(words)).astype(float)
    is_toxic, weight = seen["y"].to_numpy() > 0.5, seen["weight"].to_numpy()
    cost = (weight * ~is_toxic) @ hits / clean * toxic * LIFT
    need, free, kept = np.where(is_toxic, 2.0, 0.0), np.ones(len(words), bool), []
    while len(kept) < most and free.any():
        gain = np.where(free, (weight * np.minimum(need, 1)) @ hits - cost, -np.inf)
        if gain.max() < 2:
            break
        k = max(np.flatnonzero(gain >= max(2, 0.97 * gain.max())).tolist(), key=lambda k: (len(words[k][0]), gain[k]))  # of much the same, the most specific
        kept.append(words[k])
        need = np.maximum(need - hits[:, k], 0)
        free &= [not (s.startswith(words[k][0]) or words[k][0].startswith(s)) for s, _ in words]
    return [(s.encode(), n) for s, n in kept]


@dataclass
class Classifier:
    stems: list[Stem]
    labels: LabelModel
    linear: Logistic | None  # None: too few labels, the label model scores

    def score(self, stems: np.ndarray, extra: np.ndarray) -> np.ndarray:
        if self.linear is None:
            return self.labels.posterior(votes(stems, extra, self.labels.spare)[0].astype(float))
        return 1 / (1 + np.exp(-np.clip(self.linear.logit(features(stems, extra, self.labels.spare)), -30, 30)))


def _count_rows(shared):
    def run(it):
        counter = Counter(shared.value)
        for pdf in it:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                stems, extra = counter.count(part["text"])
                yield pd.DataFrame({
                    "i": part["i"], "held": part["held"], "stems": [r.tobytes() for r in np.minimum(stems, 65535).astype(np.uint16)], "extra": [r.tobytes() for r in extra.astype(np.float32)],
                })

    return run


def _score_rows(shared):
    def run(it):
        for pdf in it:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                found = shared.value.score(*_counts(part))
                yield pd.DataFrame({"i": part["i"], "held": part["held"], "score": found})

    return run


def _shingle_rows(it):
    """The least hash of a text's five-word shingles: near copies mostly share it."""
    for pdf in it:
        for at in range(0, len(pdf), 256):
            part = pdf.iloc[at : at + 256]
            words, bounds = word_hashes(part["text"])
            least = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                w, k = words[a:b], min(5, b - a)
                h = np.zeros(max(1, b - a - k + 1), np.uint64)
                with np.errstate(over="ignore"):
                    for i in range(k):
                        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
                least.append(int(mix(h).view(np.int64).min()))
            yield pd.DataFrame({"i": part["i"], "y": part["y"], "text": part["text"], "least": least})


def classify(docs: DataFrame, labels: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> tuple[DataFrame, Classifier]:
    """(``id_col, held_out, score``, the classifier): rows for which ``held`` (over the id) holds are scored but take no part in the fit."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    train = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y"), F.coalesce(held, F.lit(False)).alias("held")).where("y is not null and i is not null and not held")
    train = train.groupBy("i").agg(F.when(F.avg("y") >= 0.5, 1.0).otherwise(0.0).alias("y"))
    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    picked = [train.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(per_class) for y in (0.0, 1.0)]
    both = own.where("not held").join(F.broadcast(picked[0].unionByName(picked[1])), "i")  # at most 2 * per_class ids
    one = both.groupBy("i").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    sample, sample_path = store(one.mapInPandas(_shingle_rows, f"i {kind}, y double, text string, least long"))
    copies = sample.groupBy("least", "y").agg((1 / F.count("*")).alias("weight"))
    sample = sample.join(F.broadcast(copies), ["least", "y"])  # at most 2 * per_class rows
    found = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.sum("weight").alias("n")).collect()}
    clean, toxic = (found.get(y, 0) for y in (0.0, 1.0))
    known = clean >= 4 and toxic >= 4
    stems = mine_stems(sample, toxic, clean) if known else []
    shared = spark.sparkContext.broadcast(stems)
    made = f"i {kind}, held boolean, stems binary, extra binary"
    table, path = store(own.mapInPandas(_count_rows(shared), made))
    spare = spared(stems)
    direction = votes(np.zeros((1, len(stems)), np.int64), np.zeros((1, len(_EXTRA))), spare)[1]
    unheld = table.where("not held")
    if known:
        prior = (sizes.get(1.0, 0) + 1) / (sizes.get(0.0, 0) + sizes.get(1.0, 0) + 2)
        rows = sample.select("i", "y", "weight", "text", F.lit(False).alias("held"))
        counted = rows.select("i", "y", "weight").join(rows.mapInPandas(_count_rows(shared), made), "i").orderBy(F.xxhash64("i"), "i").toPandas()  # at most 2 * per_class rows
        y = counted["y"].to_numpy()
        s, e = _counts(counted)
        fired = votes(s, e, spare)[0].astype(float)
        weight = counted["weight"].to_numpy() * np.where(y > 0.5, prior / toxic, (1 - prior) / clean) * (toxic + clean)
        seen = (weight[:, None] * fired).sum(0)
        right = np.where(direction > 0, (weight * y) @ fired, (weight * (1 - y)) @ fired) / np.maximum(seen, 1e-9)
        model = fit_label_model(unheld, direction, prior, spare, seen, right)
        target, x, cal = model.posterior(fired), features(s, e, spare), np.arange(len(y)) % 4 == 3
        linear = Logistic().fit(x[~cal], target[~cal], weight[~cal])
        if min((y[cal] == c).sum() for c in (0, 1)):
            linear.calibrate(x[cal], y[cal])
            drawn = y[cal].mean()
            linear.shift += float(np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn)))
        fitted = Classifier(stems, model, linear)
    else:
        nothing = np.zeros(len(direction))
        fitted = Classifier(stems, fit_label_model(unheld, direction, 0.05, spare, nothing, nothing), None)
    discard(spark, sample_path)
    weights = spark.sparkContext.broadcast(fitted)
    scored, _ = store(table.mapInPandas(_score_rows(weights), f"i {kind}, held boolean, score double"))
    discard(spark, path)
    return scored.select(F.col("i").alias(id_col), F.col("held").alias("held_out"), "score"), fitted
