import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawforge.llm import pairs, subjects


def test_counts_with_large_baskets(spark):
    rng = np.random.RandomState(5)
    rows = [(f"b{b}", int(i)) for b in range(40) for i in rng.choice(60, rng.randint(1, 50), replace=False)]
    rows += rows[:50] + [(None, 1), ("b1", None)]
    inc = spark.createDataFrame(rows, "basket string, item int")
    want = Counter()
    for b in {r[0] for r in rows if r[0]}:
        want.update(combinations(sorted({i for x, i in rows if x == b and i is not None}), 2))
    for block in (256, 7):
        lists = pairs.baskets_of(inc, "basket", "item", block)
        assert {(r.item_a, r.item_b): r.n_ab for r in pairs.count_pairs(lists).collect()} == want
    a = {(r.item_a, r.item_b): r for r in pairs.pair_surprise(pairs.baskets_of(inc, "basket", "item", 7)).collect()}
    b = {(r.item_a, r.item_b): r for r in pairs.pair_surprise(pairs.baskets_of(inc, "basket", "item")).collect()}
    assert set(a) == set(want) and all(a[k].expected == pytest.approx(b[k].expected) for k in a)
    assert a[next(iter(a))].n == 40


def test_null_honours_frequencies_and_sizes(spark):
    f = spark.createDataFrame([(2, 5), (7, 3), (9, 1)], "n long, items long")  # 40 links
    s = spark.createDataFrame([(2, 5), (3, 10)], "size long, baskets long")
    x, model = pairs.fit_null(f, s)
    x = {r.n: r.x for r in x.collect()}
    p = lambda n, y: 1 / (1 + math.exp(-x[n] - y))
    for n in (2, 7, 9):
        assert sum(b * p(n, y) for _, b, y in model) == pytest.approx(n)
    for size, _, y in model:
        assert sum(m * p(n, y) for n, m in ((2, 5), (7, 3), (9, 1))) == pytest.approx(size)


def tail_slowly(k, q, n):
    pmf = np.array([1.0])
    for p, m in zip(q, n):
        for _ in range(int(m)):
            pmf = np.convolve(pmf, [1 - p, p])
    return pmf[int(k) :].sum()


def test_tails():
    q, n = np.array([[0.02, 0.1, 0.3], [0.001, 0.002, 0.01]]), np.array([40.0, 25.0, 10.0])
    for k in (2, 8, 12, 16, 20):
        got = pairs.log_tail(np.array([k, k]), q, n)
        for g, row in zip(got, q):
            want = math.log(tail_slowly(k, row, n))
            assert g == pytest.approx(want, rel=0.05, abs=0.2), (k, row)
    assert pairs.log_tail(np.array([0, 75]), q[[0, 0]], n)[0] == 0.0
    assert pairs.log_tail(np.array([75]), q[:1], n)[0] == pytest.approx(float(np.log(q[0]) @ n))


def test_discoveries(spark):
    rng = np.random.RandomState(2)
    lp = np.round(np.log(rng.uniform(size=400)) * np.where(rng.uniform(size=400) < 0.1, 8, 1), 2)
    lp[100:300] = lp[100]  # most rows have one value
    df = spark.createDataFrame([(i, i % 7, float(v)) for i, v in enumerate(lp)], "item_a int, item_b int, log_p double")
    got = {r.item_a: r.log_q for r in pairs.control_discoveries(df, 1000, block=16).collect()}
    order = np.sort(lp)
    raw = {v: v + math.log(1000) - math.log((lp <= v).sum()) for v in set(order)}
    for i, v in enumerate(lp):
        assert got[i] == pytest.approx(min(0.0, min(r for w, r in raw.items() if w >= v)))


def test_fit_with_certain_links_and_on_executors(spark):
    rng = np.random.RandomState(3)
    links = rng.uniform(size=(40, 200)) < 0.2 + 0.7 * rng.uniform(size=(40, 1)) * rng.uniform(size=(1, 200))
    links[3], links[7, :], links[:, 5], links[:, 9] = True, False, True, False
    links[3, 9] = True
    n, items = np.unique(links.sum(axis=1), return_counts=True)
    size, baskets = np.unique(links.sum(axis=0), return_counts=True)
    x, y = pairs.solve(n, items, size, baskets)
    p = pairs._sigmoid(x[:, None] + y)
    assert p @ baskets == pytest.approx(n, abs=1e-6) and items @ p == pytest.approx(size, abs=1e-6)
    assert p[n == 200].min() == 1.0
    for got, want in zip(pairs.solve(n, items, size, baskets, pairs._on_executors(spark)), (x, y)):
        assert got == pytest.approx(want)
    with pytest.raises(ArithmeticError):
        pairs.solve(n, items, size, baskets, lambda want, own, weight, other: np.stack([own, want * 2]))


def test_thousands_of_sizes(spark, monkeypatch):
    rng = np.random.RandomState(6)
    size = np.arange(2, 5002)
    chance = rng.uniform(0.01, 0.3, 30_000)
    links = int(chance.sum() * 100)
    n = np.maximum(1, (chance * links / chance.sum()).astype(int))
    extra = int(n.sum() - size.sum())
    sizes = {int(s): 1 for s in size}
    sizes[2] += extra // 2
    sizes[3] += 0
    n[0] += int(sum(s * b for s, b in sizes.items()) - n.sum())
    assert sum(s * b for s, b in sizes.items()) == n.sum()
    f, items = np.unique(n, return_counts=True)
    s, b = np.array(sorted(sizes)), np.array([sizes[k] for k in sorted(sizes)])
    x, y = pairs.solve(f, items, s, b)
    model = list(zip(s.tolist(), b.tolist(), y.tolist()))
    rows = [(1, 2, k, int(f[5]), int(f[9]), float(x[5]), float(x[9])) for k in (1, 3)] * 500
    df = spark.createDataFrame(rows, "item_a int, item_b int, n_ab long, n_a long, n_b long, x_a double, x_b double")
    monkeypatch.setattr(pairs, "CELLS", 20_000)
    got = {(r.n_ab, r.expected, r.log_p) for r in pairs.surprise(df, model).collect()}
    q = pairs._sigmoid(x[5] + y) * pairs._sigmoid(x[9] + y)
    assert len(got) == 2
    for k, expected, log_p in got:
        assert expected == pytest.approx(float(q @ b)) and log_p == pytest.approx(float(pairs.log_tail(np.array([k]), q[None], b)[0]))


def test_least_count_keeps_the_adjusted_tails(spark):
    inc = spark.createDataFrame([(b, i) for b in range(60) for i in range(8) if (b * 7 + i * i) % (i + 2) < 2], "basket int, item int")
    lists = pairs.baskets_of(inc, "basket", "item")
    all_ = {(r.item_a, r.item_b): r for r in pairs.pair_surprise(lists).collect()}
    some = {(r.item_a, r.item_b): r for r in pairs.pair_surprise(lists, 10).collect()}
    assert set(some) == {k for k, r in all_.items() if r.n_ab >= 10} and some


def test_empty_pairs(spark):
    inc = spark.createDataFrame([], "basket string, item int")
    assert pairs.pair_surprise(pairs.baskets_of(inc, "basket", "item")).count() == 0


NOUNS = {"law": ["judges", "courts", "leases"], "sport": ["rowers", "medals", "courts"], "food": ["onions", "sauces", "ovens"]}


def page(rng, parts):
    out = ["Law\nSport\nFood", "Menu | Law"]
    for subject, n in parts:
        for _ in range(n):
            a, b = rng.choice(NOUNS[subject], 2, replace=False)
            out.append(f"Many {a} met the {b} of {subject}land in 19{rng.randint(10, 99)}.")
    out.append("All rights reserved. Print.")
    return "\n".join(out)


def test_patterns_equal_counting(spark):
    rng = np.random.RandomState(9)
    rows = [(sorted({f"w{i}" for i in rng.choice(12, rng.randint(1, 8))}), ["x", "y"][int(rng.randint(2))]) for _ in range(150)]
    df = spark.createDataFrame(rows, "words array<string>, subject string")
    for longest in (1, 2, 3):
        want = {}
        for ws, s in rows:
            for k in range(1, longest + 1):
                for c in combinations(ws, k):
                    want.setdefault(c, Counter())[s] += 1
        want = {(c, s): (sum(n.values()), m) for c, n in want.items() if sum(n.values()) >= 6 for s, m in n.items()}
        got = subjects.patterns(df, ["x", "y"], longest, 6).collect()
        assert {(tuple(r.words), r.subject): (r.n, r.freq) for r in got} == want and len(got) == len(want)


def test_growth_is_bounded_by_the_longest_rule(spark):
    """One sentence of forty telling words on forty pages has 2^40 patterns; only short ones are grown."""
    words = [f"notice{i}" for i in range(40)]
    rows = [(d, words, "law") for d in range(40)] + [(100 + d, [f"other{d % 2}"], "sport") for d in range(60)]
    rules = subjects.mine(spark.createDataFrame(rows, "doc_id long, words array<string>, subject string")).collect()
    assert {len(r.words) for r in rules} == {1} and len(rules) == 42


def test_subjects(spark):
    rng = np.random.RandomState(4)
    docs, truth, labels = [], {}, []
    for i in range(240):
        subject = ["law", "sport", "food"][i % 3]
        other = ["sport", "food", "law"][i % 3]
        parts = [(subject, 6)] + ([(other, 3)] if i % 4 == 0 else [(other, 1)] if i % 4 == 1 else [])
        docs.append((i, page(rng, parts), "x"))
        truth[i] = {s for s, n in parts if n >= 0.25 * sum(m for _, m in parts)}
        if i % 2 == 0:
            labels.append((i, subject if i % 40 else other, "a"))
    docs += [(900, None, "x"), (901, "", "x"), (902, "Law\nSport", "x"), (903, "Nothing to see here.", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    rules = subjects.fit(d, spark.createDataFrame(labels + labels[:3] + [(5, None, "b")], "doc_id long, subject string, text string"))
    got = {}
    for r in subjects.assign(d, rules).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i) == truth[i] for i in truth)
    assert right >= 0.95 * len(truth)
    assert not set(got) & {900, 901, 902, 903}
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert subjects.fit(d, none) is None and subjects.assign(d, None).count() == 0
    assert subjects.assign(d.limit(0), rules).count() == 0


def test_every_labelled_sentence_is_mined(spark):
    """Forty sentences a page, each with a word of its own: the same ones would always be beyond the first 24."""
    words = {s: [f"{s}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)] for s in ("law", "sport")}
    docs = [(d, "\n".join(f"Some {w} again." for w in words[s])) for d in range(40) for s in [("law", "sport")[d % 2]]]
    labels = spark.createDataFrame([(d, ("law", "sport")[d % 2]) for d, _ in docs], "doc_id long, subject string")
    rules = subjects.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert set(words["law"] + words["sport"]) == {k for k in rules.weights if isinstance(k, str)}


def test_every_labelled_document_is_mined(spark):
    """20,500 labelled pages; the last 500 by the hash of their number are the only ones with some words."""
    last = {r.id for r in spark.range(20_500).orderBy(F.xxhash64("id"), "id").tail(500)}
    own = {"law": "leases tenants", "sport": "rowers medals"}
    docs = []
    for d in range(20_500):
        s = ("law", "sport")[d % 2]
        docs.append((d, f"The {s} {s}base {own[s] if d in last else ''}.", s))
    df = spark.createDataFrame(docs, "doc_id long, text string, subject string").repartition(8)
    rules = subjects.fit(df.select("doc_id", "text"), df.select("doc_id", "subject"))
    assert {"leases", "tenants", "rowers", "medals"} <= set(rules.weights)


def test_labels_joined_by_shuffle_give_the_same(spark, monkeypatch):
    rng = np.random.RandomState(8)
    docs = [(i, page(rng, [(["law", "sport", "food"][i % 3], 5)])) for i in range(90)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, ["law", "sport", "food"][i % 3]) for i, _ in docs], "doc_id long, subject string")
    sent = subjects.fit(d, labels)
    monkeypatch.setattr(subjects, "LABELS_SENT", 5)
    shuffled = subjects.fit(d, labels)
    assert sent.steps == shuffled.steps and sent.best == shuffled.best and sent.weights.keys() == shuffled.weights.keys()
    assert all((sent.weights[k] == shuffled.weights[k]).all() for k in sent.weights)


def test_calibration_equals_all_at_once(spark):
    rng = np.random.RandomState(12)
    for n, ties in ((600, 30), (101, 4), (1, 1)):
        m = np.round(rng.uniform(size=n) * ties) / 7
        right = rng.uniform(size=n) < 0.3 + 0.6 * m / (m.max() + 1)
        df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(m, right)], "margin double, right boolean").repartition(7)
        blocks, best = subjects.calibration(df)
        assert best == pytest.approx(right[m >= np.median(m)].mean())
        want = {v: right[m == v].mean() for v in set(m)}
        size = {v: (m == v).sum() for v in want}
        keys = sorted(want)
        fitted = [max(min(np.average([want[v] for v in keys[i : j + 1]], weights=[size[v] for v in keys[i : j + 1]]) for j in range(k, len(keys))) for i in range(k + 1)) for k in range(len(keys))]
        steps = subjects.pooled(blocks)
        assert [next(r / a for b, r, a in reversed(steps) if b <= v) for v in keys] == pytest.approx(fitted)
    assert subjects.calibration(df.limit(0)) == ([], 1.0)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"p1_found", "p6_found", "p7_found", "p8_found"} <= names
    assert F is not None
