"""Toxicity: counts by definition, a label model that finds accuracies, and held-out documents of made corpora."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeforge.llm import toxicity

STEMS = [(b"blor", 1), ("zü".encode(), 2), (b"gru", 1)]


def test_counts_are_those_of_words():
    texts = ["Blor blorx xblor BLOR", "zü Züge zübel, zü-zü", None, "", "you are such a gruXX! IDIOT!", "WHY SHOUT LIKE THIS ALL OF THE DAY LONG AND NOT REST OR SLEEP AT ALL", "a" * 10_000]
    stems, extra = toxicity.Counter(STEMS).count(texts)
    for t, got, more in zip(texts, stems, extra, strict=True):
        words = [w.translate(toxicity._LOWER) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
        assert got.tolist() == [sum(w.encode().startswith(s) for w in words) for s, _ in STEMS]
        assert more[0] == len(words) and more[1] == sum(w in toxicity.LEXICON for w in words)
    assert extra[4, 2] == 1 and extra[4, 4] == 2 and extra[5, 3] == 1 and extra[0, 3] == 0
    fired, direction = toxicity.votes(stems, extra, toxicity.spared(STEMS))
    assert fired[:, :3].tolist() == [[True, False, False], [False, True, False], [False] * 3, [False] * 3, [False, False, True], [False] * 3, [False] * 3]
    assert (direction < 0).sum() == 4 and fired[2, -4]


def test_correlated_voters_share_one_vote():
    rng = np.random.default_rng(1)
    a, b = rng.random(5000) < 0.3, rng.random(5000) < 0.3
    x = np.stack([a, a, a, b], 1).astype(float)
    rest = x - x.mean(0)
    assert np.allclose(toxicity.correlated_share(rest.T @ rest), [1 / 3, 1 / 3, 1 / 3, 1], atol=0.05)


def corpus(n, seed=3, rate=0.2):
    """Two languages of made words; toxic texts have several words of two stems or the general lexicon; some clean texts one."""
    rng, out = random.Random(seed), []
    syllables = {"a": ["ka", "lo", "mi", "tu", "re", "no"], "b": ["sch", "ung", "ver", "ein", "ge", "heit"]}
    mark = {"a": ["idiot", "moron", "loser"], "b": ["grubver", "grubein", "grubge", "grubheit"]}
    for i in range(n):
        lang, bad = rng.choice("ab"), rng.random() < rate
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(15, 150))]
        for _ in range(rng.randrange(2, 7) if bad else int(lang == "b" and rng.random() < 0.1)):
            words.insert(rng.randrange(len(words)), rng.choice(mark[lang]))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_held_out_documents(spark):
    made = corpus(2400)
    rows = [(i, t) for i, t, _ in made] + [(9000, None), (9001, ""), (9002, "idiot " * 20_000), (None, "x"), (5, made[5][1]), (6, "other text")]
    clash = [F.lit(0).alias(c) for c in ("i", "held", "stems", "extra", "score", "y", "weight", "least")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *clash)
    labels = spark.createDataFrame([(i, y) for i, _, y in made if i % 5 < 3] + [(None, 1), (7, None), (3, made[3][2])], "doc_id long, toxic int").select("*", *clash)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out, model = toxicity.classify(docs, labels, held)
    got = out.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got) == sorted(-1 if i is None else i for i, _ in rows)
    assert all(r.held_out is not None and 0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got if r.doc_id != 6}
    truth = {i: y for i, _, y in made}
    test = [r.doc_id for r in got if r.held_out and r.doc_id in truth and r.doc_id != 6]
    assert len(test) > 600
    right = [(score[i] >= 0.7) == bool(truth[i]) for i in test]
    assert np.mean(right) > 0.97
    assert np.mean([score[i] >= 0.7 for i in test if not truth[i]]) < 0.01
    assert score[9000] == score[9001] < 0.2 and score[9002] > 0.7
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    # labels of held documents change nothing
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again, _ = toxicity.classify(docs, other, held)
    assert {(r.doc_id, round(r.score, 9)) for r in again.collect()} == {(r.doc_id, round(r.score, 9)) for r in got}
    assert any(s.startswith(b"gru") for s, _ in model.stems)
    # a voter's accuracy is near the share of its firings that are right
    table = toxicity.Counter(model.stems).count([t for _, t, _ in made])
    fired, direction = toxicity.votes(*table, toxicity.spared(model.stems))
    y = np.array([t for _, _, t in made])
    for j in np.flatnonzero(fired.sum(0) > 150):
        assert abs((y[fired[:, j]] == (direction[j] > 0)).mean() - model.labels.right[j]) < 0.12


def test_copies_do_not_make_stems(spark):
    made = corpus(900, seed=8)
    copy = "qworp yalmin drest volk " * 15
    docs = spark.createDataFrame([(i, t) for i, t, _ in made] + [(5000 + i, f"{copy} idiot moron loser idiot") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made] + [(5000 + i, 1) for i in range(200)], "doc_id long, toxic int")
    _, model = toxicity.classify(docs, labels, F.lit(False))
    assert not any(s.startswith((b"qwo", b"yal", b"dre", b"vol")) for s, _ in model.stems)


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, None)]])
def test_without_both_classes_the_general_voters_score(spark, labels):
    docs = spark.createDataFrame([(1, "you are an idiot and a moron, loser, scum"), (2, "a calm text"), (3, None)], "doc_id long, text string")
    out, model = toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(False))
    got = {r.doc_id: r.score for r in out.collect()}
    assert model.linear is None and got[1] > 0.5 > got[2] and len(got) == 3
    empty, _ = toxicity.classify(docs.where("false"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(False))
    assert empty.count() == 0 and empty.columns == ["doc_id", "held_out", "score"]


def test_stems_that_cost_more_than_they_bring_end_the_mining(spark):
    toxic, clean = 40, 400
    texts = [(1.0, 1.0, "qworpal drestvo yalminz")] * toxic + [(0.0, 1.0, "yalminz calm" if i < 5 else "calm") for i in range(clean)]
    stems = toxicity.mine_stems(spark.createDataFrame(texts, "y double, weight double, text string"), toxic, clean)
    assert {s for s, _ in stems} == {b"qworpal", b"drestvo"}
