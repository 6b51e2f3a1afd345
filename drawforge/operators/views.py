"""Draw views: cleaned draws in order, their balls in long form, and trailing windows by blocks of draws."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import global_index, spread
from ..schema import BALLS, MAX_BALL, NUM_CHANCE_MAX

#: Draws of one block of a trailing window; at least the longest window.
BLOCK = 4096


def first_valid(draws: DataFrame) -> DataFrame:
    """Per trimmed key the valid row that arrived first: balls in 1..49, chance number in 1..10.

    Rows that fail are dropped before the keys are compared, so that they do not hide a later valid row. Null or
    blank keys are no keys. Balls may repeat within a draw.
    """
    ok = F.col("numero_chance").between(1, NUM_CHANCE_MAX) & (F.trim("annee_numero") != "")
    for b in BALLS:
        ok = ok & F.col(b).between(1, MAX_BALL)
    key = F.trim("annee_numero")
    rest = ["draw_date", "date_tirage", F.trim("jour_tirage").alias("jour_tirage"), *BALLS, "numero_chance", "combinaison_croissante"]
    kept = draws.filter(ok).select(key.alias("annee_numero"), "draw_idx", *rest)
    payload = F.struct(*[c for c in kept.columns if c not in ("annee_numero", "draw_idx")])
    one = kept.groupBy("annee_numero").agg(F.min_by(payload, "draw_idx").alias("p"))
    return one.select("annee_numero", "p.*")


def ordered_draws(draws: DataFrame, order: str = "text") -> DataFrame:
    """`first_valid` with `di`, the 0-based position of the draw.

    order="text" sorts dd/MM/yyyy as text (the observed order of the sequence operators), order="date" by time; a
    null date comes first, ties go by key.
    """
    first = F.coalesce("date_tirage", F.lit("")) if order == "text" else F.col("draw_date").asc_nulls_first()
    return global_index(first_valid(draws), [first, F.col("annee_numero")], "di")


def occurrences(draws: DataFrame, *keep: str) -> DataFrame:
    """(keep..., pos, ball): one row per ball of a draw; null balls are left out."""
    long = draws.select(*keep, F.posexplode(F.array(*BALLS)).alias("pos", "ball")).filter("ball is not null")
    return long.withColumn("pos", F.col("pos") + 1)


def by_blocks(ordered: DataFrame, halo: int, width: int = BLOCK) -> DataFrame:
    """`ordered` with `block`; the last `halo` draws before a block are repeated in it (di < block * width).

    A block holds at most width + halo draws, whatever the number of draws.
    """
    own = F.floor(F.col("di") / width)
    reach = F.floor((F.col("di") + halo) / width)
    return ordered.withColumn("block", F.explode(F.sequence(own, reach)))


class Trailing:
    """One block of draws, with the counts of what came in the `window` draws before each of its own draws."""

    def __init__(self, frame: pd.DataFrame, width: int = BLOCK):
        frame = frame.sort_values("di", kind="stable")
        self.di = frame["di"].to_numpy(dtype=np.int64)
        self.balls = frame[BALLS].to_numpy(dtype=np.int64)
        self.chance = frame["numero_chance"].to_numpy(dtype=np.int64)
        self.day = frame["jour_tirage"].to_numpy()
        self.own = np.flatnonzero(self.di >= int(frame["block"].iloc[0]) * width)

    def ordinals(self, item: np.ndarray, n: int) -> np.ndarray:
        """[draw, item] place of the first time an item comes in a draw (draw * columns + column), else a large number."""
        rows, cols = item.shape
        out = np.full((rows, n), np.iinfo(np.int64).max, dtype=np.int64)
        for c in range(cols - 1, -1, -1):
            out[np.arange(rows), item[:, c]] = np.arange(rows) * cols + c
        return out

    def counts(self, item: np.ndarray, n: int, window: int) -> np.ndarray:
        """[own draw, item] times that each item 0..n-1 came in the window before the draw."""
        row = np.arange(1, len(item) + 1)[:, None]
        hits = np.bincount((row * n + item).ravel(), minlength=(len(item) + 1) * n).reshape(-1, n)
        total = np.cumsum(hits, axis=0, dtype=np.int32)
        return total[self.own] - total[np.maximum(self.own - window, 0)]

    def first_seen(self, item: np.ndarray, n: int, window: int) -> np.ndarray:
        """[own draw, item] place of the first time in the window before the draw; a large number if there is none.

        A time after the window may be given for an item that does not come in it; its count is 0.
        """
        later = np.minimum.accumulate(self.ordinals(item, n)[::-1], axis=0)[::-1]
        return later[np.maximum(self.own - window, 0)]


def over_blocks(ordered: DataFrame, halo: int, kernel: Callable[[Trailing], pd.DataFrame], schema: str, width: int = BLOCK) -> DataFrame:
    """Applies `kernel` to every block; it returns rows for the block's own draws."""
    width = max(width, halo)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return kernel(Trailing(frame, width))

    cols = ["di", *BALLS, "numero_chance", "jour_tirage"]
    blocks = by_blocks(ordered.select(*cols), halo, width)
    # a block made of the halo alone has no draw of its own
    last = ordered.agg(F.max("di").alias("_max"))
    blocks = blocks.join(F.broadcast(last), F.col("block") * width <= F.col("_max")).drop("_max")
    return spread(blocks, "block").groupBy("block").applyInPandas(run, schema)
