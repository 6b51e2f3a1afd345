"""Pairs and triplets of balls within a draw, and the significance of pairs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import BALLS, MAX_BALL, NUM_BALLS

#: chi-square of one degree of freedom at p = 0.05 and 0.01
CHI2_05, CHI2_01 = 3.841458820694124, 6.634896601021214
#: Coefficients of ln(erfc(z) / t) + z^2 in t = 1 / (1 + z / 2), from a published Chebyshev fit.
ERFC_FIT = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def _sorted_balls() -> Column:
    return F.array_sort(F.array_compact(F.array(*BALLS)))


def _tuples(k: int) -> Column:
    """All k-combinations of the sorted balls, as structs in lexicographic order of their places.

    A draw of five gives C(5, k) at most, whatever the table's size; a shorter draw gives those it has.
    """
    names = "abc"[:k]
    made = [F.struct(*[F.get("_s", F.lit(i)).alias(x) for i, x in zip(places, names)]) for places in combinations(range(NUM_BALLS), k)]
    return F.filter(F.array(*made), lambda t: t[names[-1]].isNotNull())


def pair_counts(draws: DataFrame) -> DataFrame:
    """(a, b, cnt), a <= b; a = b only for a ball repeated in a draw. No self-join: pairs never leave their row."""
    pairs = draws.withColumn("_s", _sorted_balls()).select(F.explode(_tuples(2)).alias("p")).select("p.a", "p.b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("cnt"))


def pair_matrix(draws: DataFrame) -> DataFrame:
    """(ball, c1..c49): the symmetric matrix with zeros, rows 1..49."""
    half = pair_counts(draws)
    both = half.unionByName(half.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cnt"))
    cells = both.groupBy("a").pivot("b", list(range(1, MAX_BALL + 1))).agg(F.sum("cnt"))
    domain = draws.sparkSession.range(1, MAX_BALL + 1).select(F.col("id").cast("int").alias("ball"))
    return domain.join(cells, domain["ball"] == cells["a"], "left").select(
        "ball", *[F.coalesce(F.col(str(i)), F.lit(0)).cast("long").alias(f"c{i}") for i in range(1, MAX_BALL + 1)]
    )


def triplets(ordered: DataFrame, top: int = 30) -> DataFrame:
    """(rank, a, b, c, cnt) of the most frequent triplets; ties go by first appearance (draw, then order in it)."""
    t = ordered.withColumn("_s", _sorted_balls()).select("di", F.posexplode(_tuples(3)).alias("i", "t"))
    t = t.select(F.col("t.a").alias("a"), F.col("t.b").alias("b"), F.col("t.c").alias("c"), (F.col("di") * 10 + F.col("i")).alias("place"))
    counted = t.groupBy("a", "b", "c").agg(F.count("*").alias("cnt"), F.min("place").alias("first"))
    best = counted.orderBy(F.desc("cnt"), "first").limit(top)
    return best.select(F.row_number().over(W.orderBy(F.desc("cnt"), "first")).cast("int").alias("rank"), "a", "b", "c", "cnt")


def chi2_tail(x: Column) -> Column:
    """Upper tail of chi-square of one degree of freedom, erfc(sqrt(x / 2)), to a relative error of 1.2e-7 (a Chebyshev
    fit, which any SQL can repeat)."""
    z = F.sqrt(x / 2)
    t = F.lit(1.0) / (F.lit(1.0) + z / 2)
    fit = F.lit(0.0)
    for c in reversed(ERFC_FIT):
        fit = fit * t + F.lit(c)
    return t * F.exp(-z * z + fit)


def pair_significance(draws: DataFrame, mode: str = "observed", top: int = 50) -> DataFrame:
    """(a, b, cnt, expected, chi2, p_value, p05, p01) of the `top` most frequent pairs: chi-square 2x2 with Yates' correction.

    mode="observed" keeps two slips of the sequence analysis: a pair (a, b) carries the count of (a, b - 1), pairs
    one apart drop out, and n * (5/49)^2 * 2 is expected; mode="intended" expects n * (5 * 4) / (49 * 48). Ties go
    by (a, b). An empty input has no rows.
    """
    counts = pair_counts(draws)
    if mode == "observed":
        counts = counts.select("a", (F.col("b") + 1).alias("b"), "cnt").filter(f"b <= {MAX_BALL}")
        rate = (NUM_BALLS / MAX_BALL) ** 2 * 2
    else:
        counts = counts.filter("a < b")
        rate = NUM_BALLS * (NUM_BALLS - 1) / (MAX_BALL * (MAX_BALL - 1))
    best = counts.orderBy(F.desc("cnt"), "a", "b").limit(top)
    n = draws.agg(F.count("*").alias("n"))  # one row
    e = F.col("n") * F.lit(rate)
    d = F.greatest(F.lit(0.0), F.abs(F.col("cnt") - F.col("expected")) / 2 - F.lit(0.5))
    o = F.col("cnt") + F.col("expected")
    chi2 = d * d * (F.lit(4.0) / o + F.lit(4.0) / (F.lit(2.0) * F.col("n") - o))
    out = best.join(F.broadcast(n)).withColumn("expected", e).withColumn("chi2", chi2)
    return out.select("a", "b", "cnt", "expected", "chi2", chi2_tail(F.col("chi2")).alias("p_value"), (F.col("chi2") > CHI2_05).alias("p05"), (F.col("chi2") > CHI2_01).alias("p01"))
