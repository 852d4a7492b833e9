"""Periodic runs and product codes against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeforge.llm import periodic_runs, product_codes


def all_runs(w, least=24, times=3):
    """Every lag, place by place; of equal stretches the smallest lag."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                out.setdefault((s, i + q - s), q)
            i += i == s
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


def made(rng, letters):
    """Words with periods, periods within periods and copied stretches."""
    w = []
    for _ in range(rng.randrange(1, 12)):
        turn = rng.random()
        if turn < 0.3:
            w += [rng.randrange(letters) for _ in range(rng.randrange(1, 30))]
        elif turn < 0.75:
            p = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 12, 13, 20, 40]))]
            p = p + p[: len(p) // 2] + p if rng.random() < 0.4 else p
            w += (p * 12)[: rng.randrange(1, len(p) * 6 + 2)]
        elif w:
            i = rng.randrange(len(w))
            w += w[i : i + rng.randrange(1, 60)]
    return w


def test_runs_are_all_runs():
    rng, seen = random.Random(4), 0
    for _ in range(1500):
        w = made(rng, rng.choice([1, 2, 3, 5]))
        want = all_runs(w)
        assert periodic_runs.find_runs(np.array(w, np.int64)) == want, w
        seen += len(want)
    assert seen > 500


def test_runs_with_other_limits():
    rng = random.Random(9)
    for least, times in ((9, 3), (40, 4), (100, 5)):
        for _ in range(150):
            w = made(rng, 2)
            assert periodic_runs.find_runs(np.array(w, np.int64), least, times) == all_runs(w, least, times)
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(None, times=2)


@pytest.mark.parametrize("n", [5_000, 60_000])
def test_long_texts_take_no_square_of_pairs(n):
    assert periodic_runs.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    block = np.random.default_rng(1).integers(0, 1 << 20, n // 4)
    assert periodic_runs.find_runs(np.tile(block, 4)) == [(0, n, n // 4)]


def expected(doc, text):
    w = [x for x in "".join("\n" if c in " \t\n\x0b\x0c\r" else c for c in text or "").split("\n") if x]
    n = len(w)
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = all_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(told), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs(spark):
    rng = random.Random(2)
    texts = [" ".join("abcde"[i] for i in made(rng, 5)) for _ in range(120)]
    texts += [None, "", " \n\t ", "x", "a b c " * 30, "   a\x1cb " * 40, "é ß " * 400 + "z", "w " * 3000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "a b " * 20), (3, texts[3]), (3, "other " * 30)]
    clash = [F.lit("x").alias(c) for c in ("runs", "n_runs", "start", "collapsed", "n_words")]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *clash)
    out = periodic_runs.periodic_runs(df, fold=True)
    got = out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(periodic_runs.runs_text(F.col("runs")), 256), F.sha2("collapsed", 256)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(*d)) for d in docs)
    assert sum(r.n_runs for r in got) > 50
    assert out.where("doc_id < 0").count() == 0 == periodic_runs.periodic_runs(df.where("false")).count()
    plain = {r.doc_id: r for r in periodic_runs.periodic_runs(df.where("doc_id = 124")).collect()}
    assert [tuple(r) for r in plain[124].runs] == [(0, 90, 3)] and plain[124].collapsed == "a b c"


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(codes, errors, codebooks) in Python integers."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    x = [[int(np.floor(1024 * np.float64(c))) for c in v] for _, v in rows]
    d = len(x[0]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for v in x]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    for r in range(rounds + 1):
        found = []
        for v in cut:
            found.append([min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)])
        if r == rounds:
            break
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [(i, "".join(f"{e:02x}" for _, e in f), sum(e for e, _ in f)) for (i, _), f in zip(rows, found, strict=True)], books


ODD = [(9000, None, 1), (9002, [1.0, None] + [0.0] * 6, 1), (9003, [float("nan")] + [1.0] * 7, 1), (9004, [float("-inf")] + [1.0] * 7, 1), (9005, [], 1), (9006, [1.0] * 4, 1), (9007, [1e9] * 8, 1), (None, [1.0] * 8, 1)]


@pytest.mark.parametrize(("n", "entries"), [(700, 256), (90, 256), (400, 24), (300, 1)])
def test_codes_are_those_of_the_plain_computation(spark, n, entries):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(30, 8))
    x = (centres[rng.integers(0, 30, n)] + rng.normal(scale=0.2, size=(n, 8))).astype(np.float32)
    x[10:40] = x[10]  # copies: ties between entries
    x[50] = 0
    rows = [(int(i) * 3 - 50, [float(c) for c in v], None if i % 7 == 0 else int(i % 5)) for i, v in enumerate(x)]
    rows += [rows[60], (rows[61][0], rows[62][1], 2)]  # a repeated row, an id with another vector
    clash = [F.lit(0).alias(c) for c in ("x", "own", "near", "low", "need", "error", "rows")]
    df = spark.createDataFrame(rows + ODD, "vec_id long, embedding array<float>, label int").select("*", *clash).repartition(5)
    want, books = plain_codes([r[:2] for r in rows], entries=entries)
    coded, got_books = product_codes.compress(df, entries=entries)
    assert [b.tolist() for b in got_books] == books
    assert sorted(map(tuple, coded.select("vec_id", "code", "error").collect())) == sorted(want)
    out = product_codes.codes(df, entries=entries).collect()
    label = {}
    names = sorted(rows, key=lambda r: (r[0], r[1]))
    for (_, _, lab), (_, _, e) in zip(names, want, strict=True):
        label[lab] = label.get(lab, 0) + e
    ids = {}
    for (i, _, lab), (_, c, _) in zip(names, want, strict=True):
        ids.setdefault((i, c), set()).add(label[lab])
    assert len(out) == len(rows) and all(r.label_error in ids[r.vec_id, r.code] for r in out)
    text = ",".join(str(c) for b in books for e in b for c in e)
    assert {r.codebooks_sha256 for r in out} == {hashlib.sha256(text.encode()).hexdigest()}


def test_bounds_settle_most_parts():
    """Lists and bounds give what all distances give, while few parts need all of them."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(3000, 8)) * 500).astype(np.int64)
    books = x[:64].copy()
    own, near, low, _ = product_codes.assign_all(x, books, 12)
    for b in (12, 6, 6, 20, 20):
        now = np.stack([x[own == k].sum(0) // max(1, (own == k).sum()) if (own == k).any() else books[k] for k in range(64)])
        moved = np.sqrt(((now - books) ** 2).sum(1).astype(float))
        books = now
        own, near, low, need = product_codes.assign_bounded(x, books, moved, own.copy(), near.copy(), low, b)
        d = product_codes.distances(x, books)
        assert (own == d.argmin(1)).all()
        assert (np.take_along_axis(d, near, 1) >= np.minimum(low[:, :-1], 1e9) ** 2 * (1 - 1e-9) - 1e-6).all() or b == 20
        rest = d.astype(float)
        rest[np.arange(len(d)), own] = np.inf
        np.put_along_axis(rest, near, np.inf, 1)
        assert (np.sqrt(rest.min(1)) >= low[:, -1] - 1e-6).all()
    assert (need == 255).mean() < 0.5
    big = np.array([[1 << 25, -(1 << 25)]])
    assert product_codes.distances(big, -big).tolist() == [[2 * (1 << 26) ** 2]]


def test_empty_tables_and_lengths_that_have_no_parts(spark):
    kind = "vec_id long, embedding array<double>, label string"
    for rows in ([], [(1, [1.0, 2.0, 3.0], "a")], [(1, None, None)]):
        assert product_codes.codes(spark.createDataFrame(rows, kind)).count() == 0
    one = product_codes.codes(spark.createDataFrame([(5, [0.5, -0.5, 0.0, 1.0], None)], kind)).collect()
    assert one[0].code == "00000000" and one[0].error == 0 and one[0].label_error == 0
    assert one[0].codebooks_sha256 == hashlib.sha256(b"512,-512,0,1024").hexdigest()
