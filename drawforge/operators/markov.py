"""Transitions between the balls of consecutive draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import BALLS
from .frequency import ball_domain
from .views import occurrences


def transitions(ordered: DataFrame) -> DataFrame:
    """(from_ball, to_ball, cnt, prob): how often a ball of a draw is followed by a ball of the next.

    prob = cnt / times of from_ball in all draws, the last included, so that a row sums to about five. The next
    draw is met by an equi-join on its position, each draw being one row with its balls; pairs are made after it.
    """
    sets = ordered.select("di", F.array_compact(F.array(*BALLS)).alias("balls"))
    prev = sets.select((F.col("di") + 1).alias("di"), F.col("balls").alias("before"))
    steps = sets.join(prev, "di").select(F.explode("before").alias("from_ball"), "balls")
    cnt = steps.select("from_ball", F.explode("balls").alias("to_ball")).groupBy("from_ball", "to_ball").agg(F.count("*").alias("cnt"))
    marginal = occurrences(ordered).groupBy(F.col("ball").alias("from_ball")).agg(F.count("*").alias("m"))
    # one row per ball
    return cnt.join(F.broadcast(marginal), "from_ball").select("from_ball", "to_ball", "cnt", (F.col("cnt") / F.col("m")).alias("prob"))


def lookup(trans: DataFrame, from_ball: int, to_ball: int) -> DataFrame:
    """One row (from_ball, to_ball, prob): 0 for a transition never seen or outside 1..49."""
    hit = trans.filter((F.col("from_ball") == from_ball) & (F.col("to_ball") == to_ball))
    return hit.agg(F.coalesce(F.max("prob"), F.lit(0.0)).alias("prob")).select(
        F.lit(from_ball).alias("from_ball"), F.lit(to_ball).alias("to_ball"), "prob"
    )


def predict_next(ordered: DataFrame, trans: DataFrame | None = None, top: int = 10) -> DataFrame:
    """(rank, ball, score): the ten likeliest balls after the last draw, without its own, as shares of all scores.

    Ties go to the larger ball. Balls without any transition have score 0 and fill up the ten.
    """
    trans = transitions(ordered) if trans is None else trans
    last = ordered.agg(F.max("di").alias("di"))
    balls = occurrences(ordered.join(F.broadcast(last), "di", "left_semi")).select("ball")  # five rows
    score = trans.join(F.broadcast(balls.withColumnRenamed("ball", "from_ball")), "from_ball").groupBy("to_ball").agg(F.sum("prob").alias("s"))
    rest = ball_domain(ordered).join(F.broadcast(balls), "ball", "left_anti")
    filled = rest.join(score, F.col("ball") == F.col("to_ball"), "left").select("ball", F.coalesce("s", F.lit(0.0)).alias("s"))
    # at most 49 rows from here on
    total = F.sum("s").over(W.partitionBy())
    share = F.when(total > 0, F.col("s") / total).otherwise(F.lit(0.0))
    order = W.orderBy(F.desc("score"), F.desc("ball"))
    ranked = filled.select("ball", share.alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top).select("rank", "ball", "score")
