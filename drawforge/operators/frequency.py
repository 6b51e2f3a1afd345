"""Frequencies, recency, gaps, chance numbers, hot and cold numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import MAX_BALL
from .views import occurrences


def ball_domain(like: DataFrame) -> DataFrame:
    """The numbers 1..49; a fixed size."""
    return like.sparkSession.range(1, MAX_BALL + 1).select(F.col("id").cast("int").alias("ball"))


def overall(draws: DataFrame) -> DataFrame:
    """(ball, cnt) over all positions; balls never drawn have no row."""
    return occurrences(draws).groupBy("ball").agg(F.count("*").alias("cnt"))


def by_position(draws: DataFrame) -> DataFrame:
    """(pos, ball, cnt) for positions 1..5."""
    return occurrences(draws).groupBy("pos", "ball").agg(F.count("*").alias("cnt"))


def recency(ordered: DataFrame, last: int = 10) -> DataFrame:
    """(ball, nth, age): the `last` most recent draws of every ball 1..49, the latest draw having age 1.

    A ball never drawn has one row with age = number of draws; without draws that is 0. Only the `last` latest draws
    of each ball pass the shuffle: they are taken within slices of 65,536 draws first.
    """
    seen = occurrences(ordered, "di").select("di", "ball").distinct().withColumn("slice", F.shiftright("di", 16))
    for keys in (["ball", "slice"], ["ball"]):
        latest = W.partitionBy(*keys).orderBy(F.desc("di"))
        seen = seen.withColumn("nth", F.row_number().over(latest)).filter(F.col("nth") <= last)
    n = ordered.agg(F.count("*").alias("n"))
    return (
        ball_domain(ordered)
        .join(F.broadcast(n))
        .join(seen.select("ball", "di", "nth"), "ball", "left")
        .select("ball", F.coalesce("nth", F.lit(1)).alias("nth"), F.coalesce(F.col("n") - F.col("di"), F.col("n")).alias("age"))
    )


def first_seen(ordered: DataFrame) -> DataFrame:
    """(ball, cnt, first): how often, and the place (draw * 5 + position) of the first time."""
    return occurrences(ordered, "di").groupBy("ball").agg(F.count("*").alias("cnt"), F.min(F.col("di") * 5 + F.col("pos")).alias("first"))


def hot_cold(ordered: DataFrame, mode: str = "observed", top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(hot, cold), each (rank, ball, cnt): above 1.1 or below 0.9 times what is expected, the ten foremost.

    mode="observed" expects (different balls / 49), so that hot is the ten most frequent and cold is empty;
    mode="intended" expects (all balls / 49). Ties go by the ball seen first.
    """
    seen = first_seen(ordered)
    size = F.count("*") if mode == "observed" else F.sum("cnt")
    total = seen.agg((size / F.lit(float(MAX_BALL))).alias("expected"))  # one row
    with_ = seen.join(F.broadcast(total))

    def ranked(rows: DataFrame, *order) -> DataFrame:
        foremost = rows.orderBy(*order).limit(top)
        return foremost.select(F.row_number().over(W.orderBy(*order)).alias("rank"), "ball", "cnt")

    hot = ranked(with_.filter(F.col("cnt") > F.col("expected") * F.lit(1.1)), F.desc("cnt"), F.asc("first"))
    # the ascending sort is stable on the descending order, in which ties go by first seen
    cold = ranked(with_.filter(F.col("cnt") < F.col("expected") * F.lit(0.9)), F.asc("cnt"), F.asc("first"))
    return hot, cold


def hot_cold_by_position(ordered: DataFrame, window: int = 10) -> DataFrame:
    """(pos, side, rank, ball, cnt): per position the first three and the last three of the frequency order."""
    long = occurrences(ordered, "di").groupBy("pos", "ball").agg(F.count("*").alias("cnt"), F.min("di").alias("first"))
    order = W.partitionBy("pos").orderBy(F.desc("cnt"), F.asc("first"))
    ranked = long.withColumn("rank", F.row_number().over(order)).withColumn("of", F.count("*").over(W.partitionBy("pos")))
    hot = F.when(F.col("rank") <= F.least(F.lit(3), F.lit(window)), F.lit("hot"))
    cold = F.when(F.col("rank") > F.col("of") - 3, F.lit("cold"))
    sides = ranked.withColumn("side", F.explode(F.array_compact(F.array(hot, cold))))
    return sides.select("pos", "side", "rank", "ball", "cnt")


def chance_overall(draws: DataFrame) -> DataFrame:
    """(chance, cnt)."""
    return draws.filter("numero_chance is not null").groupBy(F.col("numero_chance").alias("chance")).agg(F.count("*").alias("cnt"))


def chance_by_day(draws: DataFrame) -> DataFrame:
    """(jour, chance, cnt); a null day is a day of its own."""
    known = draws.filter("numero_chance is not null")
    return known.groupBy(F.col("jour_tirage").alias("jour"), F.col("numero_chance").alias("chance")).agg(F.count("*").alias("cnt"))


def draws_by_day(draws: DataFrame) -> DataFrame:
    """(jour, cnt) without null days."""
    return draws.filter("jour_tirage is not null").groupBy(F.col("jour_tirage").alias("jour")).agg(F.count("*").alias("cnt"))


def gaps(ordered: DataFrame) -> DataFrame:
    """(ball, avg_gap, absence): mean distance of successive times, and draws since the last, of balls seen twice or more.

    The mean of the gaps is (last - first) / (times - 1), so that nothing has to be sorted.
    """
    n = ordered.agg(F.count("*").alias("n"))
    per = occurrences(ordered, "di").groupBy("ball").agg(F.count("*").alias("k"), F.min("di").alias("lo"), F.max("di").alias("hi"))
    per = per.filter("k >= 2").join(F.broadcast(n))
    return per.select("ball", ((F.col("hi") - F.col("lo")) / (F.col("k") - 1)).alias("avg_gap"), (F.col("n") - F.col("hi")).alias("absence"))
