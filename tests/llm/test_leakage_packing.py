import unicodedata
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from drawforge.llm import leakage, packing
from drawforge.llm.tokens import VOCABULARY, token_counts


def words(t):
    t = "".join(c for c in unicodedata.normalize("NFD", t.casefold()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", t)


def leaks_slowly(docs, items, run):
    out = set()
    for d, t in docs:
        w = words(t or "")
        have = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for k, p in items:
            q = words(p or "")
            if any(tuple(q[i : i + run]) in have for i in range(len(q) - run + 1)):
                out.add((d, k))
    return out


def test_words():
    f = leakage.Folding()
    assert leakage.words_of("Été_ a-b  STRASSE straße 12,5 œuf", f) == ["ete", "a", "b", "strasse", "strasse", "12", "5", "œuf"]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_search_equals_slow_search(data):
    word = st.sampled_from("abcd")
    text = st.lists(word, max_size=40)
    run = data.draw(st.integers(2, 6))
    items = [(i, " ".join(w)) for i, w in enumerate(data.draw(st.lists(text, max_size=4)))]
    docs = [(i, " ".join(w)) for i, w in enumerate(data.draw(st.lists(text, max_size=6)))]
    tables = leakage.Tables([(i, t) for i, t in items if len(t.split()) >= run], run)
    got = set(tables.search([words(t) for _, t in docs]))
    assert got == leaks_slowly(docs, items, run)


def test_leaks(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [text(30) for _ in range(8)]
    docs = []
    for i in range(60):
        t = text(200)
        if i % 3 == 0:
            p, at, n = passages[i % 8], rng.randrange(8), rng.choice([11, 12, 20])
            t[50:50] = p[at : at + n]
        docs.append((i, ", ".join(w.upper() for w in t), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (0, docs[0][1], "x"), (102, " ".join(passages[0]) * 1, "x"), (103, "é" * 100_000, "x")]
    items = [(k, " ".join(p), 1) for k, p in enumerate(passages)] + [(50, " ".join(passages[0]), 1), (51, None, 1), (52, "too short", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, passage string")
    e = spark.createDataFrame(items, "item_id long, passage string, doc_id long")
    want = leaks_slowly([x[:2] for x in docs], [x[:2] for x in items], 12)
    assert want and {tuple(r) for r in leakage.leaks(d, e).collect()} == want
    assert leakage.leaks(d, e).count() == len(want)
    assert {tuple(r) for r in leakage.leaks(d, e, words_per_pass=90).collect()} == want
    assert leakage.leaks(d.limit(0), e).count() == leakage.leaks(d, e.limit(0)).count() == 0


def test_long_passages_are_cut_with_an_overlap(spark):
    long = [f"w{i}" for i in range(300)]
    e = spark.createDataFrame([(1, " ".join(long)), (2, "a b")], "item_id long, passage string")
    cut = leakage.pieces(e, 12, piece_words=50).collect()
    assert len(cut) == 6 and all(12 <= r.n <= 61 and r.n == len(r.words.split()) for r in cut)
    runs = {tuple(w[i : i + 12]) for w in (r.words.split() for r in cut) for i in range(len(w) - 11)}
    assert runs == {tuple(long[i : i + 12]) for i in range(289)}


def test_a_pattern_of_many_items(spark):
    """A passage that many items share, and blocks that end most patterns."""
    items = [(k, " ".join(["of", "the"] * 10 + [f"w{k % 5}"])) for k in range(300)]
    tables = leakage.Tables(items, 12)
    texts = ["of the " * 11, "x " + "of the " * 6 + "w3", "of the " * 5]
    assert set(tables.search([t.split() for t in texts])) == leaks_slowly(list(enumerate(texts)), items, 12)


def bound_slowly(sizes, capacity):
    best = -(-int(sum(sizes)) // capacity)
    for e in {0, *(s for s in sizes if 2 * s <= capacity)}:
        x = [capacity if s > capacity - e else 0 if s < e else int(s) for s in sizes]
        best = max(best, -(-sum(x) // capacity))
        for k in (1, 2, 3, 4, 5, 7):
            y = [v * k if (k + 1) * v % capacity == 0 else (k + 1) * v // capacity * capacity for v in x]
            best = max(best, -(-sum(y) // (k * capacity)))
    return best


def test_bound_uses_every_threshold():
    rng = np.random.RandomState(8)
    for hi in (700, 1024):
        sizes = rng.randint(1, hi, 1500)  # some 500 thresholds
        assert len({s for s in sizes if 2 * s <= 1024}) > 300
        assert packing.lower_bound(sizes, 1024) == bound_slowly(sizes, 1024)


def bins_slowly(sizes, capacity):
    """Fewest bins, by search; for a handful of items."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i]:
                place(i + 1, rooms[:j] + [rooms[j] - sizes[i]] + rooms[j + 1 :])
        place(i + 1, rooms + [capacity - sizes[i]])

    place(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_packing(sizes):
    s = np.array(sizes)
    fewest = bins_slowly(sorted(sizes, reverse=True), 20)
    assert packing.lower_bound(s, 20) <= fewest
    bins = packing.best_fit_decreasing(s, 20)
    used = np.bincount(bins, weights=s)
    assert used.max() <= 20 and bins.max() + 1 <= 11 / 9 * fewest + 1


def test_pack(spark):
    rng = np.random.RandomState(1)
    sizes = [(i, int(n)) for i, n in enumerate(rng.geometric(1 / 300, 3000))] + [(9000, 0), (9001, 1024), (9002, 5000), (9003, None)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    packed = packing.pack(df, 1024, per_partition=500)
    rows = packed.collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.tokens)
    assert {d: sum(p) for d, p in got.items()} == {d: n for d, n in sizes if n}
    assert all(len(p) == -(-sum(p) // 1024) for p in got.values()), "split only what exceeds the capacity"
    used = {}
    for r in rows:
        used[r["round"], r.part, r.bin] = used.get((r["round"], r.part, r.bin), 0) + r.tokens
    assert max(used.values()) <= 1024
    total = sum(n or 0 for _, n in sizes)
    rep = packing.report(packed, 1024).first()
    assert rep.bins == len(used) and rep.tokens == total and rep.bins <= 1.03 * total / 1024 + rep.beyond_bound
    # partitions with a gap exchange their items, and rows that repeat one document are spread as any others
    wide = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.randint(200, 700, 600))], "doc_id long, tokens long")
    exchanged = packing.pack(wide, 1024, per_partition=60).collect()
    assert {r["round"] for r in exchanged} >= {0, 2} and len(exchanged) == 600
    same = packing.pack(spark.range(2000).selectExpr("1L as doc_id", "300L as tokens"), 1024, per_partition=100)
    assert same.count() == 2000 and same.groupBy("round", "part").count().agg({"count": "max"}).first()[0] < 300
    assert packing.pack(df.limit(0), 1024).count() == 0 and packing.report(packing.pack(df.limit(0), 1024), 1024).first().bins == 0


def test_token_counts(spark):
    import os

    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary here")
    import base64

    import tiktoken

    from drawforge.llm import tokens

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello world, l'été 2024!", "wörter und zahlen 12 " * 20_000, "mot" * 60_000, "a" * 150_000 + " b", "-- " * 50_000 + "fin de"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in token_counts(df).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
