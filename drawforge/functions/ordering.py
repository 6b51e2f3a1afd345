"""Global positions and predecessors without one task that holds everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` by the hash of `key` in as many partitions as a shuffle has: little data with much work for each row
    would else be merged into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Rows of the other side that one task joins to a key of a table too large to be sent to all executors.
ROWS_PER_KEY = 1_000_000


def spread_join(
    rows: DataFrame, side: DataFrame, key: str, broadcast_rows: int, rows_per_key: int = ROWS_PER_KEY, keys: DataFrame | None = None
) -> DataFrame:
    """Left join of `side`, which has one row for a value of `key`; no value meets in one task, however many rows have it.

    A side of at most `broadcast_rows` rows, which is counted first, is sent to all executors. A larger one is
    joined by shuffle: values with more than `rows_per_key` rows are split, and their row of `side` is repeated for each part.
    `keys` may give the keys of `rows` (or of more rows), one row each, where `rows` costs more to make than to count.
    """
    if side.count() <= broadcast_rows:
        return rows.join(F.broadcast(side), key, "left")
    many = (rows if keys is None else keys).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > rows_per_key) & F.col(key).isNotNull())
    # at most one row for every `rows_per_key` rows
    hot = cut(many.select(key, F.ceil(F.col("_n") / rows_per_key).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), parts).cast("int"))
    right = side.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("_parts").join(right.drop("_parts"), [key, "_salt"], "left").drop("_salt")


def global_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name` = 0-based position of each row in the total order `order`.

    Rows are range-partitioned and sorted within their partition; a position is the partition's offset plus the
    place in it, so no task sees more than its range. The checkpoint pins the ranges: a recomputed task could
    otherwise sample other bounds than those the offsets were counted for. `order` should be unique; rows that
    tie get arbitrary distinct positions. An empty input gives an empty result.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_mid", 33))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition of the range shuffle
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_off") + place).cast("long"))
        .drop("_mid", "_part", "_off")
    )


def previous_by_blocks(df: DataFrame, keys: list[str], order: str, name: str, width: int = 4096) -> DataFrame:
    """Adds `name` = the next smaller value of the integer column `order` among rows of the same `keys`.

    (`keys`, `order`) must be unique. Windows run within blocks of `width` values of `order`, so that a key
    with a third of all rows is spread; only each block's last value goes on to the window over blocks.
    """
    blocked = df.withColumn("_b", F.floor(F.col(order) / width))
    inner = blocked.withColumn(name, F.lag(order).over(W.partitionBy(*keys, "_b").orderBy(order)))
    last = blocked.groupBy(*keys, "_b").agg(F.max(order).alias("_last"))
    over = W.partitionBy(*keys).orderBy("_b") if keys else W.orderBy("_b")
    last = last.select(*keys, "_b", F.lag("_last").over(over).alias("_before"))
    renamed = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_bb"), "_before")
    cond = [inner["_b"] == renamed["_bb"]] + [inner[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys]
    joined = inner.join(renamed, cond, "left")
    return joined.withColumn(name, F.coalesce(name, "_before")).drop(
        "_b", "_bb", "_before", *[f"_k_{k}" for k in keys]
    )
