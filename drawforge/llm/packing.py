"""Filling containers of fixed capacity: bound-certified repacking.

Items are spread over partitions of bounded size and packed by best-fit decreasing. A lower bound from dual-feasible
functions certifies a partition whose number of bins cannot be improved; the items of partitions with a gap are
exchanged among each other and packed again, for a few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Items of one partition, and rounds of exchange, before what remains is taken as it is.
PER_PARTITION, ROUNDS = 20_000, 3


def split_items(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, n_pieces, tokens): an item above the capacity in full pieces and one remainder.

    Items without tokens take no room and have no piece.
    """
    n = F.ceil(F.col("tokens") / capacity).cast("int")
    pieces = sizes.filter("tokens > 0").select("doc_id", "tokens", n.alias("n_pieces"), F.posexplode(F.array_repeat(F.lit(0), n)).alias("piece", "_0"))
    left = F.when(F.col("piece") + 1 < F.col("n_pieces"), capacity).otherwise(F.col("tokens") - (F.col("n_pieces") - 1) * capacity)
    return pieces.select("doc_id", "piece", "n_pieces", left.cast("int").alias("tokens"))


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of three families of dual-feasible functions, over all their thresholds.

    u_k rounds x = size/capacity to multiples of 1/k; U_e takes items above 1-e as whole bins and those below e as
    nothing; both are also applied one after the other. A function's sum for every threshold e comes from running sums
    over the sizes in order.
    """
    if not len(sizes):
        return 0
    size, n = np.unique(sizes.astype(np.int64), return_counts=True)
    limits = np.unique(np.concatenate([[0], size[size * 2 <= capacity]]))
    low, high = np.searchsorted(size, limits), np.searchsorted(size, capacity - limits, side="right")
    whole = n.sum() - np.concatenate([[0], np.cumsum(n)])[high]
    best = 0
    for k in (0, 1, 2, 3, 4, 5, 7):
        up = (k + 1) * size
        # values in units of 1/(k * capacity); k = 0 stands for the sizes as they are
        y = np.where(up % capacity == 0, size * k, (up // capacity) * capacity) if k else size
        so_far = np.concatenate([[0], np.cumsum(y * n)])
        sums = so_far[high] - so_far[low] + whole * max(k, 1) * capacity
        best = max(best, -(-int(sums.max()) // (max(k, 1) * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item: largest first, into the fullest bin that still has room."""
    bins = np.empty(len(sizes), dtype=np.int32)
    open_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    room = 0  # bit r is set while a bin has r left
    count = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        fits = room >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            b = open_with[left].pop()
            if not open_with[left]:
                room &= ~(1 << left)
        else:
            left, b = capacity, count
            count += 1
        bins[i] = b
        left -= s
        if left:
            open_with[left].append(b)
            room |= 1 << left
    return bins


def _pack_round(items: DataFrame, capacity: int, round_: int, partitions: int) -> DataFrame:
    # by the row's own number, so that rows which repeat a document are spread as any others
    spread = F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(partitions)).cast("int")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "row"], kind="stable")
        sizes = group["tokens"].to_numpy()
        group["bin"] = best_fit_decreasing(sizes, capacity)
        group["gap"] = int(group["bin"].max()) + 1 - lower_bound(sizes, capacity)
        return group

    keep = "row long, doc_id long, piece int, n_pieces int, tokens int, part int"
    parts = items.select("row", "doc_id", "piece", "n_pieces", "tokens", spread.alias("part"))
    packed = parts.groupBy("part").applyInPandas(pack, keep + ", bin int, gap int")
    return packed.withColumn("round", F.lit(round_))


def pack(sizes: DataFrame, capacity: int, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, n_pieces, tokens, round, part, bin, gap): every piece of every item in exactly one bin.

    A bin is named by (round, part, bin). `gap` is the partition's number of bins less its lower bound: 0 certifies
    that no packing of its items needs fewer. Full pieces are bins of their own and stay out of the exchange. No
    partition is larger than about `per_partition` items, whatever the sizes or repeats of `doc_id`. Items without
    tokens are in no bin; an empty table gives an empty one. `capacity` is at least 1.
    """
    # the checkpoint fixes the numbers of the rows
    pieces = cut(split_items(sizes, capacity).withColumn("row", F.monotonically_increasing_id()))
    full = pieces.filter(F.col("tokens") == capacity)
    # a full piece's partition names the piece itself
    done = full.select("row", "doc_id", "piece", "n_pieces", "tokens", F.lit(-1).alias("round"), F.col("doc_id").alias("part"), F.col("piece").alias("bin"), F.lit(0).alias("gap"))
    rest = pieces.filter(F.col("tokens") < capacity)
    names = ["row", "doc_id", "piece", "n_pieces", "tokens", "round", F.col("part").cast("long").alias("part"), "bin", "gap"]
    for r in range(rounds):
        n = rest.count()
        if n == 0:
            break
        packed = cut(_pack_round(rest, capacity, r, max(1, -(-n // per_partition))).select(*names))
        last = r + 1 == rounds or n <= per_partition
        done = done.unionByName(packed if last else packed.filter("gap <= 0"))
        if last:
            break
        rest = packed.filter("gap > 0")
    return done.drop("row")


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: bins, items, tokens, certified share of the bins, bins beyond the bounds, share of unused space."""
    bins = packed.groupBy("round", "part", "bin").agg(F.sum("tokens").alias("used"), F.count("*").alias("n"), F.max("gap").alias("gap"))
    parts = bins.groupBy("round", F.when(F.col("round") >= 0, F.col("part")).alias("p")).agg(
        F.count("*").alias("bins"), F.sum("n").alias("items"), F.sum("used").alias("tokens"), F.max("gap").alias("gap")
    )
    return parts.agg(
        F.coalesce(F.sum("bins"), F.lit(0)).alias("bins"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("gap"), F.lit(0)).alias("beyond_bound"),
        F.coalesce(F.sum(F.when(F.col("gap") == 0, F.col("bins"))), F.lit(0)).alias("certified_bins"),
    ).withColumn("unused", F.when(F.col("bins") > 0, 1 - F.col("tokens") / (F.col("bins") * capacity)))
