"""Winners and payouts by rank."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MAX_BALL, NUM_BALLS, RANKS

TOTAL = comb(MAX_BALL, NUM_BALLS)
#: Labels of the nine ranks.
LABELS = [
    "Jackpot (5+chance)",
    "5 bons",
    "4 bons",
    "3 bons",
    "2 bons + chance",
    "2 bons",
    "1 bon + chance",
    "1 bon",
    "Match nul (5num, chance libre)",
]
#: Probability of each rank as observed; from rank 3 on it is not that of a draw.
OBSERVED_ODDS = [
    1 / (TOTAL * 10),
    9 / (TOTAL * 10),
    220 / TOTAL,
    440 / TOTAL * 9 / 10,
    270 / TOTAL / 10,
    270 / TOTAL * 9 / 10,
    264 / TOTAL / 10,
    264 / TOTAL * 9 / 10,
    374 / TOTAL / 10,
]


def _hit(k: int) -> float:
    return comb(NUM_BALLS, k) * comb(MAX_BALL - NUM_BALLS, NUM_BALLS - k) / TOTAL


#: Hypergeometric probabilities of "5 + chance", 5, 4, 3, "2 + chance", 2, "1 + chance", 1, "0 + chance".
INTENDED_ODDS = [_hit(5) / 10, _hit(5) * 0.9, _hit(4) * 0.9, _hit(3) * 0.9, _hit(2) / 10, _hit(2) * 0.9, _hit(1) / 10, _hit(1) * 0.9, _hit(0) / 10]


def odds(spark, mode: str = "observed") -> DataFrame:
    """(rang, label, p), nine rows."""
    values = OBSERVED_ODDS if mode == "observed" else INTENDED_ODDS
    return spark.createDataFrame([(i + 1, LABELS[i], float(p)) for i, p in enumerate(values)], "rang int, label string, p double")


def long_prizes(tirages: DataFrame) -> DataFrame:
    """(rang, gagnants, rapport), nine rows a draw."""
    cells = [F.struct(F.lit(r).alias("rang"), F.col(f"gagnants_rang{r}").alias("gagnants"), F.col(f"rapport_rang{r}").alias("rapport")) for r in range(1, RANKS + 1)]
    return tirages.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def by_rank(tirages: DataFrame, mode: str = "observed") -> DataFrame:
    """One row per rank: label, draws, won, players, stake, paid, roi_pct, share, mean_won, mean_all, p, gap, gap_pct.

    A draw counts for return if it has winners and a payout. players = whole part of the winners over the rank's
    odds; paid is the sum of payouts per winner (observed) or winners times payout (intended). Ranks without such a
    draw have nulls. share is the share of draws with winners, compared with p.
    """
    paid = F.col("rapport") if mode == "observed" else F.col("gagnants") * F.col("rapport")
    pays = (F.col("gagnants") > 0) & (F.col("rapport") > 0)
    wins = F.col("gagnants") > 0
    dec = lambda c: c.cast("decimal(38,4)")
    per = long_prizes(tirages).groupBy("rang").agg(
        F.count("*").alias("draws"),
        F.count_if(wins).alias("won"),
        F.count_if(pays).alias("paying"),
        F.sum(F.when(pays, F.col("gagnants"))).alias("winners"),
        F.sum(dec(F.when(pays, paid))).cast("double").alias("paid"),
        F.sum(F.when(wins, F.col("gagnants"))).alias("won_sum"),
        F.sum("gagnants").alias("all_sum"),
    )
    o = odds(tirages.sparkSession, mode)
    r = F.broadcast(o).join(per, "rang", "left")  # nine rows
    players = F.floor(F.col("winners") / F.greatest("p", F.lit(1e-15))).cast("long")
    r = r.withColumn("players", players).withColumn("stake", F.col("players") * 2.0)
    share = F.coalesce(F.col("won") / F.greatest("draws", F.lit(1)), F.lit(0.0))
    return r.select(
        "rang",
        "label",
        F.coalesce("draws", F.lit(0)).alias("draws"),
        F.coalesce("won", F.lit(0)).alias("won"),
        F.coalesce("paying", F.lit(0)).alias("paying"),
        "players",
        "stake",
        "paid",
        F.try_divide((F.col("paid") - F.col("stake")) * 100.0, F.col("stake")).alias("roi_pct"),
        share.alias("share"),
        F.try_divide("won_sum", "won").alias("mean_won"),
        F.try_divide("all_sum", "draws").alias("mean_all"),
        "p",
        (share - F.col("p")).alias("gap"),
        ((share - F.col("p")) / F.col("p") * 100.0).alias("gap_pct"),
    )
