"""Operators on documents against plain Python, on small tables with nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shapeforge.llm import hashing, langid, licenses, line_dedup, mixing, order_minhash, pieces, quality, secrets

WORDS = "the of and ring stone river light carry under window paper green seven often letter night cloud".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", str(rng.randrange(50))]) for _ in range(n))


def table(spark, rows, extra="gone int, i long, t long, p double, id string, row string, n long, weight double"):
    """documents with columns whose names operators might use themselves."""
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    k = len(extra.split(","))
    return spark.createDataFrame([(*r, *[None] * k) for r in rows], schema)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(i, "\n".join([prose(rng, 30), " Shared LINE \t", prose(rng, 12)][: rng.randint(1, 3)]), rng.choice(["en", "de"]), f"s{i % 3}", 100) for i in range(40)]
    out += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, "a\n\n\nb", "en", None, 4), (103, "x " * 40000, None, "s1", 80000)]
    out += [(None, "shared line", "en", "s0", 3), (5, out[5][1], "en", "s2", 9), (6, "another text of six", "en", "s2", 9)]
    return out


def test_line_dedup(spark, rows):
    got = line_dedup.dedup_lines(table(spark, rows), min_docs=5)
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER)) for x in (t or "").split("\n")]
    docs = defaultdict(set)
    for i, t, *_ in rows:
        for k in keys(t):
            if k:
                docs[k].add(i)
    often = {k for k, v in docs.items() if len(v) >= 5}
    assert often
    want = Counter((i, len(keys(t)), sum(k in often for k in keys(t)), "\n".join(x for x, k in zip((t or "").split("\n"), keys(t)) if k not in often)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want
    assert {"gone", "i", "t", "p", "id"} <= set(got.columns)


def test_empty_tables(spark):
    none = table(spark, [])
    assert line_dedup.dedup_lines(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert secrets.scan_documents(none)[0].count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert pieces.decode(pieces.encode(none)).count() == 0
    assert order_minhash.near_duplicates(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(none, labels).count() == 0
    assert langid.predict(none, langid.fit(none)).count() == 0


def test_mixing_meets_marginals(spark, rows):
    docs = table(spark, rows)
    targets = mixing.given_targets(spark, {"source": {"s0": 0.5, "s1": 0.2, "s2": 0.2, mixing.NONE: 0.1, "absent": 0.4}, "lang": {"en": 0.6, "de": 0.3, mixing.NONE: 0.1}})
    cells = mixing.cells_of(docs).where("tokens > 0")
    raked = mixing.rake(cells, targets, iterations=40)
    assert raked.where("weight > tokens * 1.000001").count() == 0
    want = {(r["axis"], r["value"]): r["share"] for r in mixing.aims(cells, targets).collect()}
    assert want["source", "s0"] == pytest.approx(0.5) and ("source", "absent") not in want
    total = raked.agg(F.sum("weight")).first()[0]
    for axis in ("source", "lang"):
        for r in raked.groupBy(axis).agg(F.sum("weight").alias("w")).collect():
            assert r["w"] / total == pytest.approx(want[axis, r[axis]], rel=1e-3)
    out = mixing.mix(docs, targets).collect()
    assert len(out) == len(rows) and all(0 <= r.mix_probability <= 1 for r in out)
    again = {(r.doc_id, r.mix_kept) for r in mixing.mix(docs.repartition(7), targets).collect()}
    assert {(r.doc_id, r.mix_kept) for r in out} == again


def test_drawn_documents_meet_the_targets(spark):
    """A hot source, a rare topic: what is drawn meets all three marginals up to sampling error."""
    rng = random.Random(31)
    rows = []
    for i in range(6000):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(4)}"
        t = prose(rng, 30) if rng.random() < 0.9 else " | ".join(prose(rng, 1) for _ in range(30))
        rows.append((i, t * (1 if rng.random() < 0.8 else 4), "en" if rng.random() < 0.7 else "de", source, 1))
    docs = table(spark, rows)
    out = mixing.mix(docs).toPandas()
    drawn = out[out.mix_kept]
    before, after, tokens, cells = {}, {}, drawn.mix_tokens.sum(), mixing.cells_of(docs)
    want = mixing.aims(cells, mixing.tempered_targets(cells)).toPandas().groupby("axis").apply(lambda x: dict(zip(x.value, x.share)), include_groups=False)
    for axis in ("source", "lang", "mix_topic"):
        for value, share in want["topic" if axis == "mix_topic" else axis].items():
            before[axis, value] = out[out[axis] == value].mix_tokens.sum() / out.mix_tokens.sum()
            after[axis, value] = (drawn[drawn[axis] == value].mix_tokens.sum() / tokens, share)
    assert all(got == pytest.approx(share, rel=0.15, abs=0.01) for got, share in after.values())
    assert after["source", "hot"][1] < before["source", "hot"] - 0.03 and len(drawn) > 0.45 * len(out)


def test_topics_from_a_lexicon(spark):
    docs = table(spark, [(1, "A river, the River", "en", "s", 1), (2, "paper and light", "en", "s", 1), (3, None, "en", "s", 1)])
    lexicon = {"nature": ["river", "stone"], "office": ["paper", "light"]}
    assert {r.doc_id: r.mix_topic for r in mixing.mix(docs, lexicon=lexicon).collect()} == {1: "nature", 2: "office", 3: "other"}


def spans_by_hand(text):
    found = []
    for rank, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern.replace("(?i:", "(?ai:"), text):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), rank, f"{rule.kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(found))


def test_secret_spans_and_ledger(spark):
    texts = [
        "é🙂 Password = 'abcdefgh1' token=short secret: AKIAABCDEFGHIJKL AKIA12", "x" * 50 + "0123456789abcdef" * 3, None, "", "token = password= abcdefgh1234",
        "api_key:\"AAAA+/=._-bbbb\" api-key=zzzzzzzzzz deadbeef", "-----BEGIN RSA PRIVATE KEY----- ghp_abcdefghijklmnopqrstuvwx", "secret=aaaaaaaa secret=aaaaaaaa",
    ]
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts + texts[:1])])
    found, ledger = secrets.scan_documents(docs)
    got = {r.doc_id: r.s for r in found.select("doc_id", secrets.span_text(F.col("spans")).alias("s")).collect()}
    assert got == {i: spans_by_hand(t or "") for i, t in enumerate(texts + texts[:1])}
    assert any("assign" in x for x in got.values()) and "access" in got[0]
    # null and the empty text are one blob, copies another
    assert ledger.select("blob_id").distinct().count() == len(texts) - 1
    assert secrets.scan_unseen(docs, ledger).count() == 0
    newer = tuple(secrets.Rule(r.kind, r.pattern, r.group, r.least, 2 if r.kind == "hex" else 1) for r in secrets.RULES)
    again = secrets.scan_unseen(docs, ledger, newer)
    assert {(r.rule, r.rule_version) for r in again.select("rule", "rule_version").distinct().collect()} == {("hex", 2)}


def test_secret_spans_of_very_many_matches(spark):
    """20,000 matches and a text of megabytes take time in proportion."""
    text = "".join(f"é{k} token=abcdefgh{k}\n" for k in range(20_000))
    docs = table(spark, [(1, text, "en", "s", 1), (2, "x" * 3_000_000 + " secret=abcdefgh", "en", "s", 1)])
    began = time.time()
    got = {r.doc_id: r.s for r in secrets.scan_documents(docs)[0].select("doc_id", secrets.span_text(F.col("spans")).alias("s")).collect()}
    assert time.time() - began < 60
    assert got == {1: spans_by_hand(text), 2: "assign:3000001:3000016"}


def test_licenses_against_brute_force(spark):
    mit, gpl = licenses.TEMPLATES["mit-text"], licenses.TEMPLATES["gpl-header"]
    cutdown = " ".join(mit.split()[:-6])
    rng = random.Random(2)
    texts = [
        prose(rng, 300) + "\n\n" + mit + "\n\n" + prose(rng, 20), prose(rng, 200) + " " + gpl + " " + prose(rng, 200), cutdown, " ".join(mit.split()[:20]), None, "", "...",
        "GNU  General, Public-License and the MIT\nLicense; cc by! ccby xmit license éMIT license", "mit license mit license", prose(rng, 50),
    ]
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split()
            for k in range(len(words)):
                if words[k : k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        more = {}
        for label, template in licenses.TEMPLATES.items():
            own = {w.lower() for w in re.findall("[0-9A-Za-z]+", template)}
            width = 2 * len(re.findall("[0-9A-Za-z]+", template))
            share = max(len(own & set(words[k : k + width])) / len(own) for k in range(max(1, len(words))))
            if share >= 0.8:
                more[label] = share
        assert r.labels == ",".join(sorted(labels | set(more)))
        assert r.score == pytest.approx(max([1.0 if places else 0.0, *more.values()]))
    assert "mit-text" in got[0].labels and "gpl-header" in got[1].labels and "mit-text" in got[2].labels


def test_licenses_leave_scattered_words_alone(spark):
    rng = random.Random(12)
    words = licenses.TEMPLATES["cc-by-text"].split()
    scattered = prose(rng, 5000).split()
    for k, w in enumerate(words):
        scattered[k * 150] = w
    docs = table(spark, [(1, " ".join(scattered), "en", "s", 1), (2, " ".join(scattered[:3000] + words + scattered[3000:]), "en", "s", 1)])
    given = spark.createDataFrame([("cc-by-text", " ".join(words)), (None, "x")], "label string, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs, templates=licenses.templates_of(given)).collect()}
    assert got == {1: "", 2: "cc-by-text"}


def test_licenses_over_blank_lines(spark):
    rng = random.Random(11)
    apache, bsd = licenses.TEMPLATES["apache-header"], licenses.TEMPLATES["bsd-text"]
    apache = apache.replace("http www apache org licenses LICENSE-2.0", "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n")
    bsd = bsd.replace("are met: ", "are met:\n\n  1. ")
    own = {"long": " ".join(f"term{k}" for k in range(300)), "short": "alpha beta gamma delta epsilon"}
    texts = [
        prose(rng, 90) + "\n\n" + apache + "\n\n" + prose(rng, 40), bsd, prose(rng, 115) + " " + own["long"].replace("term150", "\n\n") + " " + prose(rng, 500),
        "alpha beta " + prose(rng, 3) + "\n\ngamma delta " + prose(rng, 9), "alpha beta " + prose(rng, 15) + "\n\ngamma delta", "epsilon\n\n" * 3 + "alpha beta gamma alpha", None,
    ]
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    labels = set()
    for templates in (licenses.TEMPLATES, own):
        got = {r.doc_id: r for r in licenses.scan_licenses(docs, templates=templates, phrases={}).collect()}
        words_of = lambda t: re.findall("[0-9a-z]+", (t or "").lower())
        for i, t in enumerate(texts):
            words, want = words_of(t), {}
            for label, template in templates.items():
                tokens, width = set(words_of(template)), 2 * len(words_of(template))
                blocks = [words[k : k + width] for k in range(max(1, len(words)))]
                share = max(len(tokens & set(block)) / len(tokens) for block in blocks)
                if share >= 0.8:
                    want[label] = share
            assert got[i].labels == ",".join(sorted(want)) and got[i].score == pytest.approx(max([0.0, *want.values()]))
            labels |= {(i, label) for label in want}
    assert labels == {(0, "apache-header"), (1, "bsd-text"), (2, "long"), (3, "short"), (5, "short")}


def test_sentencepiece_is_exact(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(3)
    letters = list(" \n\taeioutnrs.,!(){}0123éßñ▁🙂中\x00ا")
    texts = [None, "", " ", "a  b ", "\n", "▁x", "don't stop.\nNow", "x" * 3000, " " * 40 + "the", "a" + " " * 100_000 + "b", "word " * 50_000] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    for r in pieces.decode(pieces.encode(docs)).collect():
        want = sp.encode(texts[r.doc_id] or "")
        assert list(r.ids) == want and r.decoded == sp.decode(want)
    both = {r.doc_id: (list(r.ids), r.back) for r in pieces.encode(docs, decoded="back").collect()}
    assert both == {i: (sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in enumerate(texts)}
    coder = pieces.Coder(pieces.read_model(pieces.model_path()))
    for _ in range(200):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(8)]
        assert coder.decode(ids) == sp.decode(ids)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    rng = random.Random(4)
    pairs, want = [], []
    for _ in range(300):
        a = [rng.randrange(5) for _ in range(rng.randint(0, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 7)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = [rng.randrange(5)] * rng.randint(0, 1)
        limit = rng.randint(0, 6)
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64), limit))
        want.append(edit_distance(a, b) <= limit)
    assert order_minhash.within(pairs) == want


def test_near_duplicates(spark):
    rng = random.Random(5)
    rows, group = [], {}
    for g in range(8):
        base = [rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for k in rng.sample(range(len(base)), len(base) // 25):
                copy[k] = "changed" + str(rng.randrange(100))
            group[len(rows)] = g
            rows.append((len(rows), "  ".join(copy).upper(), "en", "s", 1))
    n = len(rows)
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, "!!", "en", "s", 2), (n + 3, "!!", "en", "s", 2), (n + 4, "two words", "en", "s", 1), (n + 5, "Two, words", "en", "s", 1), (None, rows[0][1], "en", "s", 1), (0, rows[0][1], "en", "s", 1)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(table(spark, rows)).collect()}
    low = {g: min(i for i in group if group[i] == g) for g in group.values()}
    assert {i: got[i] for i in group} == {i: low[g] for i, g in group.items()}
    assert (got[n], got[n + 1], got[n + 3], got[n + 5]) == (n, n + 1, n + 2, n + 4)
    assert None not in got and len(got) == n + 6


def test_near_duplicates_that_meet_in_a_common_passage(spark):
    rng = random.Random(9)
    passage = [f"common{k}" for k in range(120)]
    rows = []
    for i in range(30):
        own = [f"own{rng.randrange(10**6)}" for _ in range(80)]
        # every other word of the own text differs: no run of five words survives, and the similarity is 0.81
        copy = [w if k % 2 or k > 74 else f"copy{rng.randrange(10**6)}" for k, w in enumerate(own)]
        rows += [(i, " ".join(passage + own), "en", "s", 1), (i + 30, " ".join(passage + copy), "en", "s", 1)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: i % 30 for i in range(60)}


def test_recall_of_isolated_pairs_at_the_threshold(spark):
    rng = random.Random(12)
    fresh = lambda: f"w{rng.randrange(10**9)}"
    rows, cases = [], [(n, kind) for n in [5, 6, 7, 8, 9] * 8 for kind in ("replaced", "one more")] + [(n, kind) for n in [10, 12, 15, 20, 40, 60, 65, 80, 100, 120, 200, 300, 420] * 12 for kind in ("replaced", "inserted", "deleted")]
    for k, (n, kind) in enumerate(cases):
        a = [fresh() for _ in range(n)]
        b = list(a)
        if kind == "one more" or kind == "inserted":
            for _ in range(1 if kind == "one more" else n // 4):  # n // 4 of n + n // 4 words
                b.insert(rng.randrange(len(b) + 1), fresh())
        elif kind == "replaced":
            for at in rng.sample(range(n), int(0.2 * n + 1e-9)):
                b[at] = fresh()
        else:
            for at in sorted(rng.sample(range(n), int(0.2 * n + 1e-9)), reverse=True):
                del b[at]
        if kind != "one more" or n > 3:
            assert n > 120 or edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
        rows += [(10_000 + 2 * k, " ".join(a), "en", "s", 1), (10_001 + 2 * k, " ".join(b), "en", "s", 1)]
    four = [fresh() for _ in range(4)]
    rows += [(1000, " ".join(four), "en", "s", 1), (1001, " ".join([*four, "more"]), "en", "s", 1), (1002, " ".join(["other", *four[1:]]), "en", "s", 1)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(table(spark, rows)).collect()}
    assert (got[1000], got[1001], got[1002]) == (1000, 1000, 1002)
    found = {}
    for k, case in enumerate(cases):
        found.setdefault(case, []).append(got[10_001 + 2 * k] == 10_000 + 2 * k)
    assert all(all(x) for (n, _), x in found.items() if n < 9)
    for kind in ("replaced", "inserted", "deleted"):
        for low, high in ((9, 64), (65, 100), (120, 500)):
            assert np.mean([y for (n, k), x in found.items() if k == kind and low <= n <= high for y in x]) >= 0.93
    with pytest.raises(ValueError):
        order_minhash.plan(0.55)


def classes_by_hand(rows, similarity=0.8):
    """doc_id to class by comparing all pairs of word lists with plain dynamic programming."""
    top = {i: i for i, _ in rows}
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            most = max(len(a), len(b))
            if top[i] != top[j] and abs(len(a) - len(b)) <= 0.2 * most and edit_distance(a, b) <= (1 - similarity) * most + 1e-9:
                x, y = sorted((top[i], top[j]))
                top = {d: x if t == y else t for d, t in top.items()}
    return top


@pytest.mark.parametrize("all_pairs, block", [(8, 512), (1, 512), (1, 3)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, all_pairs, block):
    """Few rows as a bucket's pairs, as prefixes, or as blocks: the classes are those of all pairs."""
    monkeypatch.setattr(order_minhash, "ALL_PAIRS", all_pairs)
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    rng = random.Random(21)
    passage = [f"common{k}" for k in range(30)]
    rows = []
    for n in (4, 6, 9, 14, 25, 45, 80, 140, 200) * 3:
        # few words in use, so many texts share the rarest ones, and a passage that all but the shortest share
        base = (passage if n > 9 else []) + [f"w{rng.randrange(25)}" for _ in range(n)]
        rows.append((len(rows), base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(0, int(0.26 * len(base)))):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [f"x{rng.randrange(30)}"], [copy[at], f"x{rng.randrange(30)}"]])
            if copy:
                rows.append((len(rows), copy))
    want = classes_by_hand(rows)
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(table(spark, [(i, " ".join(w), "en", "s", 1) for i, w in rows])).collect()}
    assert len(set(want.values())) > 12
    # nothing is joined that all pairs don't join; what is not met is rare
    assert all(want[i] == want[got[i]] for i in got)
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(rows)


def test_rare_runs_stay_rare_in_a_large_crowd(spark, monkeypatch):
    """Bins grow with the texts: with too few, runs of a passage look as frequent as those of one text alone, and meet as rows."""
    monkeypatch.setattr(order_minhash, "FEWEST_COUNTS", 1 << 12)
    passage = [f"common{k}" for k in range(90)]
    docs = spark.createDataFrame([(i, i, " ".join([*passage, *(f"own{i}x{k}" for k in range(90))])) for i in range(400)], "doc long, part long, text string")
    counts = order_minhash._run_counts(docs, 2)
    assert len(counts) > 400 * 90 and counts.dtype == np.uint8 and counts.max() == 255
    shared = spark.sparkContext.broadcast(counts)
    rows = docs.mapInPandas(order_minhash._prefix_rows(0.8, 2, shared), "run long, doc long, part long, n int, pos int")
    # no text need show the passage; what is counted once goes no further
    assert order_minhash._sizes(rows, "run").where("size > 8").count() == 0
    assert rows.count() < 400 * order_minhash.prefix_size(180, 0.8, 2)


def test_crowded_runs_are_few_rows_of_a_text():
    rows = pd.DataFrame({"run": [5, 1, 2, 3, 4, 6, 1], "doc": [7, 7, 7, 7, 7, 7, 8], "n": 9})
    shown = lambda runs: pd.concat(order_minhash._shown(SimpleNamespace(value=np.array(runs, np.int64)))(iter([rows])))
    assert shown([1, 2, 3, 4, 6])[["run", "doc"]].values.tolist() == [[1, 7], [2, 7], [3, 7], [4, 7], [1, 8]]
    assert shown([99]).empty


def test_repeated_ids_link_by_each_of_their_texts(spark):
    rng = random.Random(22)
    a, z = ([f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(2))
    near = lambda w: " ".join([*w[:20], "changed", *w[21:]])
    docs = table(spark, [(1, " ".join(a), "en", "s", 1), (1, " ".join(z), "en", "s", 1), (2, near(a), "en", "s", 1), (3, near(z), "en", "s", 1), (4, "another text " * 9, "en", "s", 1)])
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    # 2 holds a copy of 1's text and one that only 3 is near to: no class is left without a kept document
    docs = table(spark, [(1, " ".join(a), "en", "s", 1), (2, " ".join(a), "en", "s", 1), (2, " ".join(z), "en", "s", 1), (3, near(z), "en", "s", 1), (5, None, "en", "s", 1), (5, near(z), "en", "s", 1), (6, "", "en", "s", 1)])
    got = order_minhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 1, 5: 1, 6: 6}
    assert sorted(r.class_id for r in got if r.kept) == sorted({r.class_id for r in got})


def test_block_gives_a_forest_of_its_links():
    rng = random.Random(10)
    words = [[rng.randrange(400) for _ in range(rng.randint(5, 30))] for _ in range(20)]
    for _ in range(40):
        copy = list(rng.choice(words))
        copy[rng.randrange(len(copy))] = 999
        words.append(copy)
    block = pd.DataFrame({"doc": range(60), "text": [" ".join(f"w{x}" for x in w) for w in words], "guest": False, "part": [i // 2 for i in range(60)]})
    for side in (block["doc"] * 0, block["doc"] % 2):
        found = list(order_minhash._block_links(block.assign(side=side), 0.8).itertuples(index=False, name=None))
        links = [(b, a) for a in range(60) for b in range(a) if (not side.any() or (a + b) % 2) and edit_distance(words[a], words[b]) <= int(0.2 * max(len(words[a]), len(words[b])) + 1e-9)]

        def parts(edges):
            top = [i // 2 for i in range(60)]
            for a, b in edges:
                top = [top[a] if x == top[b] else x for x in top]
            return {tuple(i for i in range(60) if top[i] == x) for x in top}

        assert found and set(found) <= set(links) and parts(found) == parts(links) and len(found) == 30 - len(parts(links))


def test_word_hashes_tell_words_apart():
    texts = ["Ab cé, ab", None, "", "cé AB " + "q" * (1 << 20) + " ab"]
    h, bounds = hashing.word_hashes(texts)
    assert list(np.diff(bounds)) == [3, 0, 0, 4]
    assert h[0] == h[2] == h[4] == h[6] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_language_id_held_out(spark):
    rng = random.Random(6)
    syllables = {"aa": ["ba", "do", "ki", "lu"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["eau", "ou", "é", "ç"]}
    text = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40))
    rows = [(i, text(lang), lang, "s", 1) for i in range(240) for lang in [rng.choice("aa bb cc".split())]]
    rows += [(900, None, None, None, None), (901, "123 ?!", "aa", "s", 1), (902, "", "aa", "s", 1)]
    docs = table(spark, rows)
    held = F.col("doc_id") % 4 == 2
    out = langid.predict(docs, langid.fit(docs.where(~held))).collect()
    test = [r for r in out if r.doc_id < 900 and r.doc_id % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in test]) >= 0.95
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.doc_id >= 900)
    assert all(0 <= r.score <= 1 for r in out)


def test_quality_held_out(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.75
        t = prose(rng, 60)
        rows.append((i, t if good else t.upper().replace(" ", "!! "), "en", "s%d" % (i % 4), len(t)))
        labels.append((i, int(good)))
    rows += [(800, None, None, None, None), (801, "", "en", "s", 0)]
    docs = table(spark, rows)
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, known).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i].quality_kept == bool(y) for i, y in labels if i % 2 == 0]) >= 0.97
    one_class = quality.classify(docs, known.where("quality = 1"))
    assert one_class.where("quality_kept and quality_score = 0.5").count() == len(rows)


def test_query_digests(spark, tmp_path):
    """The digest columns of the queries follow from the operators' outputs."""
    from shapeforge.llm import queries

    docs = table(spark, [(1, "token=abcdefgh12\nmit license", "en", "s", 1), (2, None, "en", "s", 1)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    r = {x.doc_id: x for x in queries.op5_secret_scan(spark, str(tmp_path)).collect()}
    assert r[1].spans == "assign:0:16" and r[1].base_sha256 == hashlib.sha256(b"assign:0:16").hexdigest() and r[1].n_assign == 1
    assert r[2].base_sha256 == hashlib.sha256(b"").hexdigest() and r[2].spans == ""
    r = {x.doc_id: x for x in queries.op8_sentencepiece(spark, str(tmp_path)).collect()}
    assert r[2].n_tokens == 0 and r[2].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_an_id_repeated_very_often_is_one_row_of_the_sample(spark):
    """10,000 rows of one id: the driver gets one of them for the language model and for the classifier."""
    rows = [(i, ("the cat sat on the mat again " if i % 2 else "der hund lief durch den wald ") * 5 + str(i), "en" if i % 2 else "de", "s", 100) for i in range(200)]
    docs = table(spark, rows + [(5, f"the cat sat on the mat {k}", "en", "s", 100) for k in range(10_000)])
    model = langid.fit(docs)
    assert model is not None and model.languages == ["de", "en"]
    got = langid.predict(docs.where("doc_id < 50 and doc_id <> 5"), model, [F.col("doc_id")]).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    fitted = quality.fit(docs, labels)
    scored = docs.where("doc_id < 50 and doc_id <> 5").select("doc_id", quality.score_column(fitted, docs).alias("s")).collect()
    assert np.mean([(r.s >= 0.5) == (r.doc_id % 2 == 1) for r in scored]) > 0.95
