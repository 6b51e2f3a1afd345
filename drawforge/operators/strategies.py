"""Ticket strategies, all draws at once, and their walk-forward backtests.

A ticket for draw t depends on the draws before t only. Draws are cut into blocks with the window before them; inside a
block the counts of all windows are differences of one running sum.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rand import raw, uniform
from ..schema import MAX_BALL, NUM_BALLS, NUM_CHANCE_MAX
from .views import Trailing, over_blocks

#: Draws before the first evaluated one, in the two backtests.
WARM_UP, CHANCE_WARM_UP = 20, 50
STAKE, JACKPOT, FIVE, FOUR = 2.0, 5_000_000, 1_000_000, 150
TICKETS = "di long, strategy string, ticket int, b1 int, b2 int, b3 int, b4 int, b5 int, chance int, matches int, hit_chance boolean"
_FAR = np.iinfo(np.int64).max

#: A strategy for the main balls of chance tickets: a block of draws and a seed give five balls, rising, for each own draw.
Main = Callable[[Trailing, int], np.ndarray]


def _rows(t: Trailing, keep: np.ndarray, strategy: str, ticket: int, balls: np.ndarray, chance: np.ndarray | None) -> pd.DataFrame:
    own = t.own[keep]
    matches = (np.sort(balls, axis=1)[:, :, None] == t.balls[own][:, None, :]).any(axis=2).sum(axis=1)
    out = pd.DataFrame({"di": t.di[own], "strategy": strategy, "ticket": np.int32(ticket)})
    for i in range(NUM_BALLS):
        out[f"b{i + 1}"] = balls[:, i].astype(np.int32)
    out["chance"] = np.int32(0) if chance is None else chance.astype(np.int32)
    out["matches"] = matches.astype(np.int32)
    out["hit_chance"] = False if chance is None else chance == t.chance[own]
    return out


def _smallest(keys: np.ndarray, k: int = NUM_BALLS) -> np.ndarray:
    """The k columns with the smallest keys, ties to the smaller column, in rising order of the column."""
    order = np.argsort(keys, axis=1, kind="stable")[:, :k]
    return np.sort(order, axis=1)


def _own(t: Trailing, warm_up: int) -> np.ndarray:
    return np.flatnonzero(t.di[t.own] >= warm_up)


def hot_balls(t: Trailing, window: int) -> np.ndarray:
    """The five most frequent balls of the window; ties to the ball seen first in it. Balls never seen come last."""
    n = t.counts(t.balls, MAX_BALL + 1, window)
    first = t.first_seen(t.balls, MAX_BALL + 1, window)
    rank = np.where(n > 0, -n.astype(np.int64) * (1 << 40) + np.where(n > 0, first, 0), 1)
    rank[:, 0] = _FAR
    return _smallest(rank)


def weighted_balls(t: Trailing, window: int, bias: float, seed: int) -> np.ndarray:
    """Five balls drawn without replacement with weights (count + 1)^-bias: the five smallest of -ln(u) / weight."""
    n = t.counts(t.balls, MAX_BALL + 1, window)
    item = np.arange(MAX_BALL + 1)
    u = uniform(t.di[t.own][:, None], item[None, :], seed)
    keys = -np.log(u) * np.power(n + 1.0, bias)
    keys[:, 0] = np.inf
    return _smallest(keys)


_PAIR = np.zeros((MAX_BALL + 1, MAX_BALL + 1), dtype=np.int64)
_A, _B = np.triu_indices(MAX_BALL)
_PAIR[_A + 1, _B + 1] = np.arange(len(_A))


def partner_balls(t: Trailing, window: int, pairs: int = 30, partners: int = 10) -> np.ndarray:
    """[own draw, ball] True for the balls that weigh most in the most frequent pairs of the window.

    Pairs tie by first appearance, balls by the order in which the ranked pairs name them. A draw with fewer than
    five such balls has none.
    """
    s = np.sort(t.balls, axis=1)
    item = np.stack([_PAIR[s[:, i], s[:, j]] for i in range(NUM_BALLS) for j in range(i + 1, NUM_BALLS)], axis=1)
    n = t.counts(item, len(_A), window).astype(np.int64)
    first = t.first_seen(item, len(_A), window)
    key = np.where(n > 0, n * (1 << 40) - np.where(n > 0, first, 0), -1)
    best = np.argpartition(-key, pairs, axis=1)[:, :pairs]
    rows = np.arange(len(key))[:, None]
    best = best[rows, np.argsort(-key[rows, best], axis=1, kind="stable")]
    weight = np.zeros((len(key), MAX_BALL + 1), dtype=np.int64)
    named = np.full((len(key), MAX_BALL + 1), 2 * pairs, dtype=np.int64)
    every = np.arange(len(key))
    for r in range(pairs):
        c = n[every, best[:, r]]
        for side, ball in enumerate((_A[best[:, r]] + 1, _B[best[:, r]] + 1)):
            weight[every, ball] += c
            named[every, ball] = np.where(c > 0, np.minimum(named[every, ball], 2 * r + side), named[every, ball])
    order = np.argsort(-(weight * 1000 - named), axis=1, kind="stable")[:, :partners]
    chosen = np.zeros_like(weight, dtype=bool)
    chosen[rows, order] = weight[rows, order] > 0
    chosen[chosen.sum(axis=1) < NUM_BALLS] = False
    return chosen


@dataclass(frozen=True)
class Strategy:
    """A configured strategy; `seed` and the number of the ticket make its numbers repeatable."""

    name: str
    kind: str  # hot, cold, paired or weighted
    window: int
    tickets: int = 1
    bias: float = 1.0
    seed: int = 0

    def emit(self, t: Trailing) -> pd.DataFrame:
        keep = _own(t, WARM_UP)
        if self.kind == "hot":
            return _rows(t, keep, self.name, 1, hot_balls(t, self.window)[keep], None)
        chosen = partner_balls(t, self.window) if self.kind == "paired" else None
        made: list[np.ndarray] = []
        parts = []
        for k in range(1, self.tickets + 1):
            seed = self.seed * 1000 + k
            if chosen is None:
                balls = weighted_balls(t, self.window, self.bias, seed)
                some = keep
            else:
                u = uniform(t.di[t.own][:, None], np.arange(MAX_BALL + 1)[None, :], seed)
                balls = _smallest(np.where(chosen, u, np.inf))
                some = keep[chosen.any(axis=1)[keep]]
            again = np.zeros(len(balls), dtype=bool)
            for old in made:
                again |= (old == balls).all(axis=1)
            made.append(balls)
            some = some[~again[some]]
            parts.append(_rows(t, some, self.name, k, balls[some], None))
        return pd.concat(parts, ignore_index=True)


#: The five configured strategies of the backtest; the two weighted ones differ in their bias.
STRATEGIES = [
    Strategy("hot", "hot", 100),
    Strategy("cold", "cold", 200, seed=1),
    Strategy("paired", "paired", 200, tickets=3, seed=2),
    Strategy("weighted_1.5", "weighted", 200, tickets=3, bias=1.5, seed=3),
    Strategy("weighted_3.0", "weighted", 200, tickets=3, bias=3.0, seed=4),
]


def tickets(ordered: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """(di, strategy, ticket, b1..b5 rising, matches, ...) of every evaluated draw, from position 20 on.

    Repeated combinations of one strategy and draw are left out, so a draw may have fewer tickets than asked for.
    """
    halo = max(s.window for s in strategies)
    return over_blocks(ordered, halo, lambda t: pd.concat([s.emit(t) for s in strategies], ignore_index=True), TICKETS)


def _won(matches, hit_chance):
    return F.when((matches == NUM_BALLS) & hit_chance, JACKPOT).when(matches == NUM_BALLS, FIVE).when(matches >= 4, FOUR).otherwise(0)


def per_draw(bought: DataFrame) -> DataFrame:
    """(strategy, di, n, cost, won) of each draw with tickets."""
    return bought.groupBy("strategy", "di").agg(
        F.count("*").alias("n"), (F.count("*") * STAKE).alias("cost"), F.sum(_won(F.col("matches"), F.col("hit_chance"))).cast("long").alias("won")
    )


def backtest(ordered: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """One row per strategy: invested, won, net, roi_pct, max_win, winning_draws, draws_evaluated (draws - 20).

    With 20 draws or fewer nothing is evaluated: sums are 0 and draws_evaluated is not positive, as observed.
    """
    daily = per_draw(tickets(ordered, strategies))
    per = daily.groupBy("strategy").agg(F.sum("cost").alias("invested"), F.sum("won").alias("won"), F.max("won").alias("max_win"), F.count_if(F.col("won") > 0).alias("winning_draws"))
    names = ordered.sparkSession.createDataFrame([(s.name,) for s in strategies], "strategy string")
    n = ordered.agg((F.count("*") - WARM_UP).alias("draws_evaluated"))
    all_ = names.join(per, "strategy", "left").join(F.broadcast(n)).fillna(0)  # a row per strategy
    net = F.col("won") - F.col("invested")
    roi = F.when(F.col("invested") > 0, net / F.col("invested") * 100).otherwise(F.lit(0.0))
    return all_.select("strategy", "invested", F.col("won").cast("long").alias("won"), net.alias("net"), roi.alias("roi_pct"), "max_win", "winning_draws", "draws_evaluated")


def winning_dates(ordered: DataFrame, daily: DataFrame, first: int = 10) -> DataFrame:
    """(strategy, nth, di, date_tirage, won) of the `first` earliest draws that each strategy of `daily` wins in.

    `daily` has the columns of `per_draw`. A strategy has as many rows as it wins draws, `first` at most.
    """
    wins = F.array_sort(F.collect_list(F.struct("di", "won")))
    # wins are cut down by ranges of draws first, so that no task holds all wins of a strategy
    some = daily.filter("won > 0").groupBy("strategy", F.floor(F.col("di") / 4096)).agg(F.slice(wins, 1, first).alias("w"))
    early = W.partitionBy("strategy").orderBy("di")
    some = some.select("strategy", F.explode("w").alias("w")).select("strategy", "w.*").withColumn("nth", F.row_number().over(early)).filter(F.col("nth") <= first)
    # a few rows for each strategy
    return F.broadcast(some).join(ordered.select("di", "date_tirage"), "di").select("strategy", "nth", "di", "date_tirage", "won")


def balance(daily: DataFrame, width: int = 65_536) -> DataFrame:
    """(strategy, di, balance): won less invested up to and including each draw; sums run within blocks of draws."""
    d = daily.withColumn("b", F.floor(F.col("di") / width)).withColumn("x", F.col("won") - F.col("cost"))
    inside = F.sum("x").over(W.partitionBy("strategy", "b").orderBy("di").rowsBetween(W.unboundedPreceding, 0))
    total = d.groupBy("strategy", "b").agg(F.sum("x").alias("t"))
    before = W.partitionBy("strategy").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    total = total.select("strategy", "b", F.coalesce(F.sum("t").over(before), F.lit(0.0)).alias("so_far"))
    return d.withColumn("i", inside).join(total, ["strategy", "b"]).select("strategy", "di", (F.col("i") + F.col("so_far")).alias("balance"))


def chance_weights(t: Trailing, method: str, window: int = 200) -> np.ndarray:
    """[own draw, chance - 1] weights of the chance numbers by a method: frequency, day_conditional or recent."""
    if method == "frequency":
        return t.counts(t.chance[:, None], NUM_CHANCE_MAX + 1, window)[:, 1:] + 1.0
    if method == "recent":
        return t.counts(t.chance[:, None], NUM_CHANCE_MAX + 1, 10)[:, 1:] + 0.5
    if method != "day_conditional":
        raise ValueError(f"unknown method {method!r}")
    day, names = pd.factorize(pd.Series(t.day), use_na_sentinel=False)
    item = (day * NUM_CHANCE_MAX + t.chance - 1)[:, None]
    n = t.counts(item, len(names) * NUM_CHANCE_MAX, window).reshape(len(t.own), len(names), NUM_CHANCE_MAX)
    first = t.first_seen(item, len(names) * NUM_CHANCE_MAX, window).reshape(n.shape)
    of_day = t.counts(day[:, None], len(names), window)
    of_day = np.where(pd.isna(names)[None, :], 0, of_day)
    key = np.where(n > 0, -n.astype(np.int64) * (1 << 40) + np.where(n > 0, first, 0), 1)
    place = np.argsort(np.argsort(key, axis=2, kind="stable"), axis=2, kind="stable")
    top = np.where((place < 3) & (n > 0), n, 0)
    return (top * of_day[:, :, None]).sum(axis=1).astype(float)


def chance_order(t: Trailing, method: str, seed: int, mode: str = "default") -> np.ndarray:
    """[own draw, 2] the two chance numbers played: the first of a weighted permutation.

    The method "recent" is observed to ignore its weights and to play 1 and 2; mode="intended" uses them.
    """
    if method == "recent" and mode != "intended":
        return np.tile(np.array([1, 2]), (len(t.own), 1))
    w = chance_weights(t, method)
    u = uniform(t.di[t.own][:, None], np.arange(1, NUM_CHANCE_MAX + 1)[None, :], seed)
    with np.errstate(divide="ignore"):
        keys = np.where(w > 0, -np.log(u) / w, np.inf)
    return np.argsort(keys, axis=1, kind="stable")[:, :2] + 1


METHODS = ["frequency", "day_conditional", "recent"]


def default_main(t: Trailing, seed: int) -> np.ndarray:
    """Five balls by weights (count + 1)^-1 over the last 200 draws."""
    return weighted_balls(t, 200, 1.0, seed)


def _chance_emit(t: Trailing, method: str, mode: str, main: Main = default_main, n: int = 3) -> pd.DataFrame:
    keep = _own(t, CHANCE_WARM_UP)
    m = len(t.own)
    base = 50_000 + 100 * METHODS.index(method)
    have = np.zeros(m, dtype=np.int64)
    balls = np.zeros((n, m, NUM_BALLS), dtype=np.int64)
    chance = np.zeros((n, m), dtype=np.int64)
    for attempt in range(1, 3 * n + 1):
        if (have >= n).all():
            break
        combo = main(t, base + attempt)
        two = chance_order(t, method, base + 50 + attempt, mode)
        for j in range(2):
            new = have < n
            for k in range(n):
                new &= ~((have > k) & (balls[k] == combo).all(axis=1) & (chance[k] == two[:, j]))
            at = np.flatnonzero(new)
            balls[have[at], at] = combo[at]
            chance[have[at], at] = two[at, j]
            have[at] += 1
    parts = []
    for k in range(n):
        some = keep[have[keep] > k]
        parts.append(_rows(t, some, method, k + 1, balls[k][some], chance[k][some]))
    # the baseline plays three random chance numbers on the balls of the last ticket
    last = balls[np.maximum(have - 1, 0), np.arange(m)]
    for k in range(n):
        luck = raw(t.di[t.own], np.full(m, k), 90_000) % NUM_CHANCE_MAX + 1
        parts.append(_rows(t, keep, f"{method}/random", k + 1, last[keep], luck[keep]))
    return pd.concat(parts, ignore_index=True)


def chance_tickets(ordered: DataFrame, methods: list[str] | None = None, mode: str = "default", main: Main = default_main) -> DataFrame:
    """Three tickets with chance numbers per draw from position 50 on, and the baseline's as "<method>/random".

    `main` chooses the five balls (`hot_balls` and `weighted_balls` with their parameters set are such strategies).
    """
    methods = METHODS if methods is None else methods
    for m in methods:
        if m not in METHODS:
            raise ValueError(f"unknown method {m!r}")
    return over_blocks(ordered, 200, lambda t: pd.concat([_chance_emit(t, m, mode, main) for m in methods], ignore_index=True), TICKETS)


def chance_backtest(ordered: DataFrame, methods: list[str] | None = None, mode: str = "default", main: Main = default_main) -> DataFrame:
    """One row per method: invested, won, roi_pct, random_invested, random_won, random_roi_pct, improvement, avg_tickets."""
    methods = METHODS if methods is None else methods
    daily = per_draw(chance_tickets(ordered, methods, mode, main))
    side = F.element_at(F.split("strategy", "/"), 1).alias("method")
    luck = F.col("strategy").contains("/")
    per = daily.groupBy(side).agg(
        F.sum(F.when(~luck, F.col("cost"))).alias("invested"),
        F.sum(F.when(~luck, F.col("won"))).alias("won"),
        F.avg(F.when(~luck, F.col("n"))).alias("avg_tickets"),
        F.sum(F.when(luck, F.col("cost"))).alias("random_invested"),
        F.sum(F.when(luck, F.col("won"))).alias("random_won"),
    )
    names = ordered.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    all_ = names.join(per, "method", "left").fillna(0)
    roi = lambda w, i: F.when(F.col(i) > 0, (F.col(w) - F.col(i)) / F.col(i) * 100).otherwise(F.lit(0.0))
    all_ = all_.withColumn("roi_pct", roi("won", "invested")).withColumn("random_roi_pct", roi("random_won", "random_invested"))
    return all_.withColumn("improvement", F.col("roi_pct") - F.col("random_roi_pct"))


def custom_tickets(ordered: DataFrame, choose: Callable[[pd.DataFrame], list[list[int]]], window: int = 200) -> DataFrame:
    """Tickets of a caller's own strategy: `choose` gets the window before a draw and returns combinations.

    The slow path: Python runs once per draw, in blocks of draws.
    """

    def kernel(t: Trailing) -> pd.DataFrame:
        rows = []
        for i in t.own[_own(t, WARM_UP)]:
            past = pd.DataFrame(t.balls[max(0, i - window) : i], columns=[f"boule_{k}" for k in range(1, 6)])
            for k, combo in enumerate(choose(past), 1):
                hit = len(set(combo) & set(t.balls[i].tolist()))
                rows.append((t.di[i], "custom", k, *sorted(combo), 0, hit, False))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TICKETS.split(", ")])

    return over_blocks(ordered, window, kernel, TICKETS)


def strategy_odds() -> list[tuple[str, str, float | None, str | None]]:
    """(rank, matches, probability, ratio) of the five ranks that the strategies know."""
    from math import comb

    total = comb(MAX_BALL, NUM_BALLS)
    four = NUM_BALLS * (MAX_BALL - NUM_BALLS)
    return [
        ("rang1", "5 + chance", 1 / (total * NUM_CHANCE_MAX), f"1/{total * NUM_CHANCE_MAX}"),
        ("rang2", "5", (NUM_CHANCE_MAX - 1) / (total * NUM_CHANCE_MAX), f"1/{total}"),
        ("rang3", "4", four / total * (NUM_CHANCE_MAX - 1) / NUM_CHANCE_MAX, f"1~{total // four}"),
        ("rang4", "3", None, None),
        ("rang5", "2 + chance", None, None),
    ]
