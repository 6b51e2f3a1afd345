import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawforge.functions.ordering import global_index, previous_by_blocks
from drawforge.functions.rand import uniform
from drawforge.operators import clusters, combos, frequency, markov, periodicity, prizes, quality, stats, strategies
from drawforge.operators.views import Trailing, first_valid, occurrences, ordered_draws, over_blocks
from drawforge.schema import BALLS

SCHEMA = "draw_idx long, annee_numero string, draw_date date, date_tirage string, jour_tirage string, boule_1 int, boule_2 int, boule_3 int, boule_4 int, boule_5 int, numero_chance int, combinaison_croissante string"


def table_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def made(n, seed=7):
    rng = np.random.RandomState(seed)
    rows = []
    for i in range(n):
        b = [int(x) for x in rng.choice(49, 5, replace=False) + 1]
        day = ["LUNDI", "MERCREDI  ", "SAMEDI", None][int(rng.randint(4))]
        rows.append((i, f"1999{i:07d}", None, f"{i:06d}", day, *b, int(rng.randint(10)) + 1, "-".join(map(str, sorted(b))) + "+1"))
    return rows


@pytest.fixture(scope="module")
def sample(spark):
    rows = made(260)
    from drawforge.session import cut

    return rows, cut(ordered_draws(table_of(spark, rows)))


def test_first_valid(spark):
    rows = [
        (5, " k1 ", None, "01/01/1999", "LUNDI  ", 1, 2, 3, 4, 5, 1, None),
        (2, "k1", None, "01/01/1999", "LUNDI", 1, 2, 3, 4, 50, 1, None),
        (7, "k1", None, None, "X", 9, 2, 3, 4, 5, 1, None),
        (8, "k2", None, None, None, 1, 1, 3, 4, 5, 10, None),
        (9, "k3", None, None, None, 1, None, 3, 4, 5, 10, None),
        (10, " ", None, None, None, 1, 2, 3, 4, 5, 10, None),
        (11, None, None, None, None, 1, 2, 3, 4, 5, 10, None),
        (12, "k4", None, None, None, 1, 2, 3, 4, 5, 11, None),
    ]
    got = {r.annee_numero: r for r in first_valid(table_of(spark, rows)).collect()}
    assert set(got) == {"k1", "k2"} and got["k1"].boule_1 == 1 and got["k1"].jour_tirage == "LUNDI"
    ordered = {r.annee_numero: r.di for r in ordered_draws(table_of(spark, rows)).collect()}
    assert ordered == {"k2": 0, "k1": 1}


def test_global_index_and_previous(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    assert [r.i for r in global_index(df, [F.col("x")], "i").orderBy("x").collect()] == list(range(1000))
    rows = [("a", 1), ("a", 4), ("a", 9000), ("b", 2), (None, 3), (None, 8), ("a", 9001)]
    got = {(r.k, r.n): r.p for r in previous_by_blocks(spark.createDataFrame(rows, "k string, n int"), ["k"], "n", "p", 10).collect()}
    assert got == {("a", 1): None, ("a", 4): 1, ("a", 9000): 4, ("a", 9001): 9000, ("b", 2): None, (None, 3): None, (None, 8): 3}


def test_frequencies(sample):
    rows, d = sample
    balls = [r[5:10] for r in rows]
    count = Counter(b for draw in balls for b in draw)
    assert {r.ball: r.cnt for r in frequency.overall(d).collect()} == count
    n = len(rows)
    age = {}
    for r in frequency.recency(d).collect():
        age.setdefault(r.ball, []).append(r.age)
    for b in range(1, 50):
        assert sorted(age[b]) == sorted(n - j for j, draw in enumerate(balls) if b in draw)[:10]
    hot, cold = frequency.hot_cold(d)
    want = [(b, c) for b, c in count.most_common() if c > 49 / 49 * 1.1][:10]
    assert [(r.ball, r.cnt) for r in hot.orderBy("rank").collect()] == want and cold.count() == 0
    _, cold = frequency.hot_cold(d, "intended")
    least = sorted([(b, c) for b, c in count.most_common() if c < 5 * n / 49 * 0.9], key=lambda x: x[1])[:10]
    assert [(r.ball, r.cnt) for r in cold.orderBy("rank").collect()] == least
    places = {b: [j for j, draw in enumerate(balls) if b in draw] for b in range(1, 50)}
    for r in frequency.gaps(d).collect():
        assert r.avg_gap == pytest.approx(np.mean(np.diff(places[r.ball]))) and r.absence == n - places[r.ball][-1]


def test_pairs_and_triplets(sample):
    rows, d = sample
    pairs, triplets = Counter(), Counter()
    for r in rows:
        pairs.update(combinations(sorted(r[5:10]), 2))
        triplets.update(combinations(sorted(r[5:10]), 3))
    assert {(r.a, r.b): r.cnt for r in combos.pair_counts(d).collect()} == pairs
    got = [((r.a, r.b, r.c), r.cnt) for r in combos.triplets(d, 30).orderBy("rank").collect()]
    assert got == triplets.most_common(30)
    m = {r.ball: r for r in combos.pair_matrix(d).collect()}
    assert len(m) == 49 and all(m[a][f"c{b}"] == m[b][f"c{a}"] == c for (a, b), c in pairs.items())
    for r in combos.pair_significance(d, "intended").collect():
        e = len(rows) * 20 / (49 * 48)
        table = np.array([[r.cnt, len(rows) - r.cnt], [e, len(rows) - e]])
        exp = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
        diff = table - exp
        yates = np.sign(diff) * np.maximum(np.abs(diff) - np.minimum(0.5, np.abs(diff)), 0)
        assert r.chi2 == pytest.approx((yates**2 / exp).sum())
    shifted = combos.pair_significance(d).collect()
    assert all(r.cnt == pairs.get((r.a, r.b - 1), 0) for r in shifted)


def test_repeated_and_missing_balls(spark):
    rows = [(0, "k", None, "a", "L", 3, 3, 5, 7, None, 1, None), (1, "m", None, "b", "L", None, None, None, None, None, 1, None)]
    d = table_of(spark, rows).withColumn("di", F.col("draw_idx"))
    assert {(r.a, r.b): r.cnt for r in combos.pair_counts(d).collect()} == {(3, 3): 1, (3, 5): 2, (3, 7): 2, (5, 7): 1}
    assert occurrences(d, "di").count() == 4
    assert stats.sum_distribution(d).first().mean is None and stats.spearman_positions(d).count() == 0


def test_distributions(sample):
    rows, d = sample
    b = np.array([r[5:10] for r in rows])
    s = stats.sum_distribution(d).first()
    assert (s.mean, s.std, s["min"], s["max"], s["median"]) == pytest.approx((b.sum(1).mean(), b.sum(1).std(), b.sum(1).min(), b.sum(1).max(), np.median(b.sum(1))))
    tens = {r.decade: r for r in stats.decade_distribution(d).collect()}
    first = (b <= 10).sum(1)
    assert (tens["1-10"].mean, tens["1-10"].std) == pytest.approx((first.mean(), first.std(ddof=1)))
    f = {r.di: r for r in stats.features(d, "di").collect()}
    assert f[3]["std"] == pytest.approx(b[3].std()) and f[3]["range"] == b[3].max() - b[3].min()
    rho = {(r.i, r.j): r.rho for r in stats.spearman_positions(d).collect()}
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    assert rho[1, 1] == pytest.approx(1) and rho[2, 4] == pytest.approx(np.corrcoef(rank(b[:, 1]), rank(b[:, 3]))[0, 1])
    z = np.abs(b.sum(1) - b.sum(1).mean()) / b.sum(1).std()
    even = (b % 2 == 0).mean(1)
    ze = np.abs(even - even.mean()) / even.std()
    assert stats.anomalies(d, 2.0).count() == ((z > 2) | (ze > 2)).sum()


def test_markov(sample):
    rows, d = sample
    cnt, marginal = Counter(), Counter()
    for p, c in zip(rows, rows[1:]):
        cnt.update((x, y) for x in p[5:10] for y in c[5:10])
    marginal.update(x for r in rows for x in r[5:10])
    trans = markov.transitions(d)
    assert {(r.from_ball, r.to_ball): r.cnt for r in trans.collect()} == cnt
    score = {y: sum(cnt[x, y] / marginal[x] for x in rows[-1][5:10]) for y in range(1, 50) if y not in rows[-1][5:10]}
    total = sum(score.values())
    got = [(r.ball, r.score) for r in markov.predict_next(d, trans).orderBy("rank").collect()]
    assert [s for _, s in got] == pytest.approx(sorted((v / total for v in score.values()), reverse=True)[:10])
    assert markov.lookup(trans, 1, 60).first().prob == 0.0


def test_periodicity(sample):
    rows, d = sample
    n = len(rows)
    x = {b: np.array([float(b in r[5:10]) for r in rows]) for b in range(1, 50)}
    got = {(r.ball, r.lag): r.r for r in periodicity.acf(d).collect()}
    assert len(got) == 49 * min(n // 2, 50)
    for b in (1, 17, 49):
        m, v = x[b].mean(), x[b].var()
        for lag in (1, 7, 49):
            assert got[b, lag] == pytest.approx(np.mean((x[b][: n - lag] - m) * (x[b][lag:] - m)) / v)
    peaks = [(r.k, r.period) for r in periodicity.dft_peaks(d).filter("ball = 17").orderBy("rank").collect()]
    mag = np.abs(np.fft.rfft(x[17] - x[17].mean()))
    mag[0] = 0
    want = [k for k in np.argsort(-mag) if mag[k] > mag[1:].mean() + 2 * mag[1:].std() and 5 <= n / k <= n / 2][:5]
    assert [k for k, _ in peaks] == want and all(p == round(n / k) for k, p in peaks)


def test_long_series_are_split(sample, monkeypatch):
    d = sample[1]
    whole = {(r.ball, r.rank): r for r in periodicity.dft_peaks(d).collect()}
    monkeypatch.setattr(periodicity, "SERIES_LIMIT", 100)
    split = {(r.ball, r.rank): r for r in periodicity.dft_peaks(d).collect()}
    assert set(split) == set(whole) and len(whole) > 49
    for key, r in split.items():
        assert (r.k, r.period) == (whole[key].k, whole[key].period) and r.magnitude == pytest.approx(whole[key].magnitude)
    assert periodicity.dft_peaks(d, longest=257).count() > 49


def hot_slowly(past):
    return sorted(b for b, _ in Counter(x for draw in past for x in draw).most_common(5))


def partners_slowly(past):
    pairs = Counter()
    for draw in past:
        pairs.update(combinations(sorted(draw), 2))
    weight = Counter()
    for (a, b), c in pairs.most_common(30):
        weight[a] += c
        weight[b] += c
    return {b for b, _ in weight.most_common(10)}


def test_strategies_see_the_past_only(spark, sample):
    rows, d = sample
    balls = [r[5:10] for r in rows]
    hot = {r.di: r for r in strategies.tickets(d, [strategies.STRATEGIES[0]]).collect()}
    assert set(hot) == set(range(20, len(rows)))
    for t in (20, 21, 99, 100, 101, 150, 259):
        assert [hot[t][f"b{i}"] for i in range(1, 6)] == hot_slowly(balls[max(0, t - 100) : t])
        assert hot[t].matches == len(set(hot_slowly(balls[max(0, t - 100) : t])) & set(balls[t]))
    small = over_blocks(d, 200, lambda t: strategies.pd.DataFrame({"di": t.di[t.own], "n": strategies.partner_balls(t, 200).sum(1), "s": (strategies.partner_balls(t, 200) * np.arange(50)).sum(1)}), "di long, n int, s long", 64)
    for r in small.collect():
        if r.di >= 20:
            assert r.s == sum(partners_slowly(balls[max(0, r.di - 200) : r.di])) and r.n == 10
    cold = {r.di: r for r in strategies.tickets(d, [strategies.STRATEGIES[1]]).collect()}
    for t in (20, 230):
        c = Counter(x for draw in balls[max(0, t - 200) : t] for x in draw)
        key = {b: -math.log(uniform(np.array(t), np.array(b), 1001)) * (c[b] + 1) for b in range(1, 50)}
        assert [cold[t][f"b{i}"] for i in range(1, 6)] == sorted(sorted(key, key=key.get)[:5])


def test_blocks_do_not_change_tickets(sample):
    _, d = sample
    kernel = strategies.STRATEGIES[3].emit
    wide = {tuple(r) for r in over_blocks(d, 200, kernel, strategies.TICKETS).collect()}
    narrow = {tuple(r) for r in over_blocks(d, 200, kernel, strategies.TICKETS, 201).collect()}
    assert wide == narrow and len(wide) > 600


def test_backtests(spark, sample):
    _, d = sample
    got = {r.strategy: r for r in strategies.backtest(d, strategies.STRATEGIES).collect()}
    assert got["hot"].invested == 240 * 2.0 and got["hot"].draws_evaluated == 240
    daily = strategies.per_draw(strategies.tickets(d, [strategies.STRATEGIES[0]]))
    last = strategies.balance(daily, 50).orderBy(F.desc("di")).first()
    assert last.balance == got["hot"].won - got["hot"].invested
    chance = {r.method: r for r in strategies.chance_backtest(d).collect()}
    assert chance["recent"].invested == 210 * 6.0 and chance["frequency"].random_invested == 210 * 6.0
    recent = strategies.chance_tickets(d, ["recent"]).filter("strategy = 'recent'").select("chance").distinct().collect()
    assert {r.chance for r in recent} == {1, 2}
    with pytest.raises(ValueError):
        strategies.chance_tickets(d, ["nonsense"])
    few = d.filter("di < 20")
    none = strategies.backtest(few, strategies.STRATEGIES[:1]).first()
    assert (none.invested, none.roi_pct, none.draws_evaluated) == (0.0, 0.0, 0)
    own = strategies.custom_tickets(d, lambda past: [sorted(past.iloc[-1])], 10).filter("di = 30").first()
    assert own.ticket == 1


def test_day_conditional_weights(sample):
    rows, d = sample
    got = over_blocks(d, 200, lambda t: strategies.pd.DataFrame({"di": t.di[t.own], "w": strategies.chance_weights(t, "day_conditional").tolist()}), "di long, w array<double>", 100)
    for r in got.collect():
        past = rows[max(0, r.di - 200) : r.di]
        days = {}
        for p in past:
            days.setdefault(p[4] and p[4].strip(), Counter())[p[10]] += 1
        want = np.zeros(10)
        for day, c in days.items():
            weight = sum(1 for p in past if p[4] and p[4].strip() == day)
            for chance, k in c.most_common(3):
                want[chance - 1] += k * weight
        assert r.w == pytest.approx(want.tolist())


def test_clusters(sample):
    _, d = sample
    a = clusters.assign(d, 5, "di")
    p = clusters.profiles(a).collect()
    assert sum(r["size"] for r in p) == 260 and all(r.pct.endswith("%") for r in p)
    with pytest.raises(ValueError):
        clusters.assign(d.filter("di < 14"), 5, "di")


def test_clusters_are_the_best_of_ten_long_fits(sample, monkeypatch):
    fitted = []

    class Seen(clusters.KMeans):
        def fit(self, vectors):
            fitted.append((self.getSeed(), super().fit(vectors)))
            return fitted[-1][1]

    monkeypatch.setattr(clusters, "KMeans", Seen)
    best = clusters.fit(clusters.feature_vectors(sample[1], "di"))
    assert [s for s, _ in fitted] == list(range(42, 52)) and all(m.getMaxIter() == 300 for _, m in fitted)
    assert best.summary.trainingCost == min(m.summary.trainingCost for _, m in fitted)


def test_prizes(spark):
    cols = ["id"] + [f"{k}_rang{r}" for r in range(1, 10) for k in ("gagnants", "rapport")]
    rows = [[i] + [v for r in range(1, 10) for v in ((i + r) % 3, float(r * i))] for i in range(10)]
    t = spark.createDataFrame(rows, ", ".join(f"{c} {'double' if 'rapport' in c else 'long'}" for c in cols))
    got = {r.rang: r for r in prizes.by_rank(t).collect()}
    won = [(i + 3) % 3 for i in range(10)]
    paying = [i for i in range(10) if won[i] > 0 and 3.0 * i > 0]
    assert got[3].won == sum(w > 0 for w in won) and got[3].paid == sum(3.0 * i for i in paying)
    assert got[3].players == int(sum(won[i] for i in paying) / prizes.OBSERVED_ODDS[2])
    assert sum(prizes.INTENDED_ODDS) == pytest.approx(1 - prizes._hit(0) * 0.9 - (prizes._hit(4) + prizes._hit(3)) / 10)
    none = prizes.by_rank(t.limit(0)).collect()
    assert len(none) == 9 and all(r.roi_pct is None and r.share == 0 for r in none)


def test_quality(spark):
    base = ("k", None, "01/01/1999", "L", 1, 2, 3, 4, 5, 1)
    rows = [(1, *base, "1-2-3-4-5+1"), (2, *base, "1-3-2-4-5+1"), (3, "m", None, "", "L", 0, 2, 3, 4, 5, 1, "9-1+2"), (4, None, None, None, None, None, None, None, None, None, None, None)]
    s = quality.summary(table_of(spark, rows)).first()
    assert (s.duplicates, s.zero_balls, s.missing_dates, s.unsorted, s.status) == (1, 1, 2, 1, "ECHEC")
    assert quality.summary(table_of(spark, rows), "intended").first().zero_balls == 2
    assert quality.summary(table_of(spark, [])).first().status == "ECHEC"
    assert quality.summary(table_of(spark, rows[:1])).first().status == "SUCCES"


def test_trailing_counts():
    import pandas as pd

    frame = pd.DataFrame({"di": range(10), "block": 0, "numero_chance": 1, "jour_tirage": "x", **{b: [(i + k) % 49 + 1 for i in range(10)] for k, b in enumerate(BALLS)}})
    t = Trailing(frame)
    n = t.counts(t.balls, 50, 3)
    for i in range(10):
        want = Counter(b for row in t.balls[max(0, i - 3) : i] for b in row)
        assert {b: int(c) for b, c in enumerate(n[i]) if c} == want


def test_chi2_tail(spark):
    import math

    xs = [0.0, 1e-6, 0.44947002937552216, 1.0, 3.841458820694124, 6.634896601021214, 30.0, 200.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, p in df.select("x", combos.chi2_tail(F.col("x"))).collect():
        assert p == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=2e-7)


def test_main_balls_of_chance_tickets_are_pluggable(spark):
    d = ordered_draws(table_of(spark, made(80)))
    hot = strategies.chance_tickets(d, ["frequency"], main=lambda t, seed: strategies.hot_balls(t, 100))
    want = {r.di: [r[f"b{i}"] for i in range(1, 6)] for r in strategies.tickets(d, [strategies.STRATEGIES[0]]).collect()}
    got = hot.filter("strategy = 'frequency'").collect()
    assert got and all([r[f"b{i}"] for i in range(1, 6)] == want[r.di] for r in got)


def test_winning_dates(spark):
    d = ordered_draws(table_of(spark, made(60)))
    daily = spark.createDataFrame([("a", di, 150 * (di % 2)) for di in range(60)] + [("b", 3, 0), ("c", 59, 9)], "strategy string, di long, won long")
    got = [(r.strategy, r.nth, r.di) for r in strategies.winning_dates(d, daily).orderBy("strategy", "nth").collect()]
    assert got == [("a", k + 1, 2 * k + 1) for k in range(10)] + [("c", 1, 59)]


def test_ball_series(spark):
    d = ordered_draws(table_of(spark, made(30)))
    series = periodicity.ball_series(d)
    assert series.count() == 30 * 49 and series.agg(F.sum("hit")).first()[0] == sum(r.hits for r in periodicity.binary_series(d).collect())
    assert periodicity.verdict(periodicity.summary(d), 30).startswith(("Aucun", "1", "2", "3", "4", "5", "6", "7", "8", "9"))
