"""Distributions over draws: sums, decades, parity, features, rank correlation, anomalies."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import BALLS, MAX_BALL, NUM_BALLS

DECADES = ["1-10", "11-20", "21-30", "31-40", "41-49"]


def _total(f) -> Column:
    return sum((f(F.col(b)) for b in BALLS[1:]), f(F.col(BALLS[0])))


def _flag(c: Column) -> Column:
    return c.cast("int")


def complete(draws: DataFrame) -> DataFrame:
    """Draws with all five balls."""
    return draws.dropna(subset=BALLS)


def with_measures(draws: DataFrame) -> DataFrame:
    """Complete draws with s (sum), q (sum of squares), evens, lo, hi, d1..d5 (balls per decade); all integers."""
    tens = [_total(lambda b, k=k: _flag(F.least(F.floor((b - 1) / 10), F.lit(4)) == k)) for k in range(5)]
    return complete(draws).select(
        "*",
        _total(lambda b: b).alias("s"),
        _total(lambda b: b * b).alias("q"),
        _total(lambda b: _flag(b % 2 == 0)).alias("evens"),
        F.least(*BALLS).alias("lo"),
        F.greatest(*BALLS).alias("hi"),
        *[t.alias(f"d{k + 1}") for k, t in enumerate(tens)],
    )


def _moments(x: str) -> tuple[Column, Column]:
    """Mean and population deviation from exact integer sums; null over no rows."""
    n, s, q = F.count(x), F.sum(F.col(x).cast("long")), F.sum((F.col(x) * F.col(x)).cast("long"))
    # exact until the last step: n q - s^2 in decimals
    wide = n.cast("decimal(19,0)") * q.cast("decimal(19,0)") - s.cast("decimal(19,0)") * s.cast("decimal(19,0)")
    return F.try_divide(s, n), F.try_divide(F.sqrt(wide.cast("double")), n)


def sum_distribution(draws: DataFrame) -> DataFrame:
    """One row: mean, std (population), min, max, median of the sum of a draw; nulls without draws."""
    mean, std = _moments("s")
    m = with_measures(draws)
    return m.agg(mean.alias("mean"), std.alias("std"), F.min("s").alias("min"), F.max("s").alias("max"), F.median("s").alias("median"))


def decade_distribution(draws: DataFrame) -> DataFrame:
    """(decade, mean, std): balls per draw in each decade, std with n - 1."""
    long = with_measures(draws).select(F.posexplode(F.array(*[f"d{k}" for k in range(1, 6)])).alias("k", "x"))
    mean, pop = _moments("x")
    per = long.groupBy("k").agg(mean.alias("mean"), pop.alias("pop"), F.count("*").alias("n"))
    name = F.element_at(F.array(*[F.lit(d) for d in DECADES]), F.col("k") + 1)
    sample = F.when(F.col("n") > 1, F.col("pop") * F.sqrt(F.col("n") / (F.col("n") - 1)))
    return per.select(name.alias("decade"), "mean", sample.alias("std"))


def parity_distribution(draws: DataFrame) -> DataFrame:
    """One row: mean and population deviation of the share of even balls."""
    mean, std = _moments("evens")
    return with_measures(draws).agg((mean / NUM_BALLS).alias("mean_ratio"), (std / NUM_BALLS).alias("std_ratio"))


def features(draws: DataFrame, *keep: str) -> DataFrame:
    """(keep..., sum, even_ratio, min, max, std, mean, range, low_fraction, mid_fraction) of every complete draw."""
    fifth = lambda f: _total(lambda b: _flag(f(b))) / F.lit(float(NUM_BALLS))
    m = with_measures(draws)
    spread = F.sqrt(F.greatest((NUM_BALLS * F.col("q") - F.col("s") * F.col("s")).cast("double"), F.lit(0.0))) / NUM_BALLS
    return m.select(
        *keep,
        F.col("s").alias("sum"),
        (F.col("evens") / NUM_BALLS).alias("even_ratio"),
        F.col("lo").alias("min"),
        F.col("hi").alias("max"),
        spread.alias("std"),
        (F.col("s") / NUM_BALLS).alias("mean"),
        (F.col("hi") - F.col("lo")).alias("range"),
        fifth(lambda b: b <= 10).alias("low_fraction"),
        fifth(lambda b: b.between(21, 30)).alias("mid_fraction"),
    )


def baseline(draws: DataFrame) -> DataFrame:
    """One row: sum_mean, sum_std, even_mean, even_std."""
    (sm, ss), (em, es) = _moments("s"), _moments("evens")
    return with_measures(draws).agg(
        sm.alias("sum_mean"), ss.alias("sum_std"), (em / NUM_BALLS).alias("even_mean"), (es / NUM_BALLS).alias("even_std")
    )


def anomalies(draws: DataFrame, sigma: float = 2.5) -> DataFrame:
    """(annee_numero, date_tirage, sum, sum_z, even_ratio, even_z) of draws beyond `sigma` deviations in sum or parity.

    The deviation of parity counts as 1e-9 at least; a sum deviation of 0 gives no z and no anomaly by the sum.
    """
    one = F.broadcast(baseline(draws))  # one row
    ratio = F.col("evens") / NUM_BALLS
    z = with_measures(draws).join(one).select(
        "annee_numero",
        "date_tirage",
        F.col("s").alias("sum"),
        F.try_divide(F.abs(F.col("s") - F.col("sum_mean")), F.col("sum_std")).alias("sum_z"),
        ratio.alias("even_ratio"),
        (F.abs(ratio - F.col("even_mean")) / F.greatest("even_std", F.lit(1e-9))).alias("even_z"),
    )
    return z.filter((F.col("sum_z") > sigma) | (F.col("even_z") > sigma))


def spearman_positions(draws: DataFrame) -> DataFrame:
    """(i, j, rho) for positions i <= j: rank correlation with average ranks over complete draws; none below 10 draws.

    Ranks come from the counts of the 49 values of a position, so that nothing is sorted: the average rank of a value
    is the count of smaller ones plus half of its own. Pairs of values are counted, then correlated.
    """
    d = complete(draws)
    value = d.select(F.posexplode(F.array(*BALLS)).alias("p", "v")).groupBy("p", "v").agg(F.count("*").alias("c"))
    # at most 49 values in each of five positions
    below = W.partitionBy("p").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    rank2 = value.select("p", "v", (F.coalesce(F.sum("c").over(below), F.lit(0)) * 2 + F.col("c") + 1).alias("r2"), "c")
    cells = [
        F.struct(F.lit(i).alias("p"), F.lit(j).alias("pj"), F.col(BALLS[i]).alias("v"), F.col(BALLS[j]).alias("w"))
        for i in range(NUM_BALLS)
        for j in range(i, NUM_BALLS)
    ]
    joint = d.select(F.explode(F.array(*cells)).alias("x")).groupBy("x.p", "x.pj", "x.v", "x.w").agg(F.count("*").alias("k"))
    a = F.broadcast(rank2.select("p", "v", F.col("r2").alias("ra")))
    b = F.broadcast(rank2.select(F.col("p").alias("pj"), F.col("v").alias("w"), F.col("r2").alias("rb")))
    ranked = joint.join(a, ["p", "v"]).join(b, ["pj", "w"])
    n = F.sum("k")
    # ranks are symmetric around n + 1 (doubled), so centred products are exact integers
    wide = lambda c: c.cast("decimal(38,0)")
    ranked = ranked.withColumn("n", F.sum("k").over(W.partitionBy("p", "pj")))
    x, y = F.col("ra") - F.col("n") - 1, F.col("rb") - F.col("n") - 1
    sums = ranked.groupBy("p", "pj").agg(
        n.alias("n"), F.sum(wide(F.col("k") * x * y)).alias("xy"), F.sum(wide(F.col("k") * x * x)).alias("xx"), F.sum(wide(F.col("k") * y * y)).alias("yy")
    )
    rho = F.try_divide(F.col("xy").cast("double"), F.sqrt(F.col("xx").cast("double")) * F.sqrt(F.col("yy").cast("double")))
    return sums.filter("n >= 10").select((F.col("p") + 1).alias("i"), (F.col("pj") + 1).alias("j"), rho.alias("rho"))


def parity_against_fair(draws: DataFrame) -> DataFrame:
    """(evens, drawn, fair): draws by number of even balls, and how many of as many fair draws are expected to have it."""
    evens = sum((F.when(F.col(b) % 2 == 0, 1).otherwise(0) for b in BALLS), F.lit(0))
    per = draws.groupBy(evens.alias("evens")).agg(F.count("*").alias("drawn"))
    even = MAX_BALL // 2
    chance = [(k, comb(even, k) * comb(MAX_BALL - even, NUM_BALLS - k) / comb(MAX_BALL, NUM_BALLS)) for k in range(NUM_BALLS + 1)]
    fair = draws.sparkSession.createDataFrame(chance, "evens int, p double")  # six rows
    n = F.broadcast(draws.agg(F.count("*").alias("n")))
    return F.broadcast(fair).join(per, "evens", "left").join(n).select("evens", F.coalesce("drawn", F.lit(0)).alias("drawn"), (F.col("n") * F.col("p")).alias("fair"))
