"""Items that appear together, and how much more often than chance.

Pairs are counted exactly. Chance is a bipartite configuration model: baskets and items are linked at random so that
every item's frequency and every basket's size hold in expectation. Under it the number of baskets that contain both
items of a pair is Poisson-binomial; its upper tail is the surprise, and the false discovery rate is controlled over
all pairs of items.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import global_index, spread_join
from ..session import cut

#: Items of a basket that are paired in one place; larger baskets are paired block by block.
BLOCK_ITEMS = 256
#: Links of a basket that learn its size in one place; a larger basket is split.
SPLIT_LINKS = 65_536
#: Rounds of the fit, and the largest relative error of a frequency or size that is left.
FIT_STEPS, FIT_TOLERANCE = 500, 1e-9
#: Cells of the model (frequencies x sizes) that are held at once; a fit of more cells runs on the executors.
CELLS = 4_000_000
#: Ranks that are adjusted in one place.
RANK_BLOCK = 65_536


def baskets_of(incidence: DataFrame, basket: str, item: str, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(items, others, size): item lists of baskets, each basket's repeated items once, nulls left out.

    A basket of more than `block_items` items is cut into blocks by the hash of the item; each pair of blocks is one
    row, so that no row, and no task, holds a large basket. `others` is null where a list is paired with itself.
    """
    one = incidence.select(F.col(basket).alias("basket"), F.col(item).alias("item")).filter("basket is not null and item is not null").distinct()
    sizes = one.groupBy("basket").agg(F.count("*").alias("size"))
    sized = spread_join(one, sizes, "basket", 0, SPLIT_LINKS).withColumn("blocks", F.ceil(F.col("size") / block_items).cast("int"))
    own = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    placed = sized.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "basket", "size", "item", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    rows = placed.groupBy("basket", "size", "i", "j").agg(
        F.sort_array(F.collect_list(F.when(F.col("block") == F.col("i"), F.col("item")))).alias("items"),
        F.sort_array(F.collect_list(F.when((F.col("block") == F.col("j")) & (F.col("i") != F.col("j")), F.col("item")))).alias("others"),
    )
    return rows.select("items", F.when(F.col("i") != F.col("j"), F.col("others")).alias("others"), "size")


def count_pairs(lists: DataFrame) -> DataFrame:
    """(item_a, item_b, n_ab), item_a < item_b: in how many baskets both are. Counts are combined before the shuffle."""
    inside = F.flatten(
        F.transform("items", lambda a, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    across = F.flatten(
        F.transform(
            "items",
            lambda a: F.transform("others", lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))),
        )
    )
    pair = lists.select(F.explode(F.when(F.col("others").isNull(), inside).otherwise(across)).alias("p"))
    return pair.groupBy(F.col("p.a").alias("item_a"), F.col("p.b").alias("item_b")).agg(F.count(F.lit(1)).alias("n_ab"))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-z))


def _chunks(rows: int, columns: int) -> Iterator[slice]:
    """Slices of `rows` that hold at most CELLS cells, one row at least."""
    step = max(1, CELLS // max(columns, 1))
    return (slice(i, i + step) for i in range(0, rows, step))


def _improved(want: np.ndarray, own: np.ndarray, weight: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Own log fitness after Newton steps towards sum of weight * sigmoid(own + other) = want; then the sums at the start."""
    out, sums = own.copy(), np.empty_like(own)
    for part in _chunks(len(own), len(other)):
        for step in range(3):
            p = _sigmoid(out[part, None] + other)
            total = p @ weight
            if step == 0:
                sums[part] = total
            out[part] += np.clip((want[part] - total) / np.maximum((p * (1 - p)) @ weight, 1e-300), -2.0, 2.0)
    return np.stack([out, sums])


def _on_executors(spark: SparkSession) -> Callable[..., np.ndarray]:
    """`_improved` by blocks of rows on the executors. What comes back is two numbers a row; neither frequencies nor sizes
    can be more than the square root of twice the links."""

    def improved(want: np.ndarray, own: np.ndarray, weight: np.ndarray, other: np.ndarray) -> np.ndarray:
        tasks = min(len(own), 4 * spark.sparkContext.defaultParallelism)
        shared = spark.sparkContext.broadcast(cloudpickle.dumps((want, own, weight, other, _improved, np.array_split(np.arange(len(own)), tasks))))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            want, own, weight, other, step, blocks = pickle.loads(shared.value)
            for frame in frames:
                for k in frame["id"]:
                    at = blocks[k]
                    new = step(want[at], own[at], weight, other)
                    yield pd.DataFrame({"i": at, "out": new[0], "sums": new[1]})

        got = spark.range(0, tasks, 1, tasks).mapInPandas(run, "i long, out double, sums double").toPandas().sort_values("i")
        shared.unpersist()
        return np.stack([got["out"].to_numpy(), got["sums"].to_numpy()])

    return improved


def solve(n: np.ndarray, items: np.ndarray, size: np.ndarray, baskets: np.ndarray, improved: Callable[..., np.ndarray] = _improved) -> tuple[np.ndarray, np.ndarray]:
    """Log fitness of the items of each frequency `n` and of the baskets of each `size`.

    Items that are in every basket, baskets that hold every item, and what is then in none, are certain: they get
    values so large that they decide, the ones found first the largest, and the others are fitted without them.
    Raises ArithmeticError if FIT_STEPS rounds do not reach FIT_TOLERANCE.
    """
    n, items, size, baskets = (np.asarray(v, dtype=float) for v in (n, items, size, baskets))
    x, y = np.zeros(len(n)), np.zeros(len(size))
    left_x, left_y = np.ones(len(n), dtype=bool), np.ones(len(size), dtype=bool)
    need_x, need_y = n.copy(), size.copy()
    sure = 2.0**60
    while left_x.any() and left_y.any():
        all_baskets, all_items = baskets[left_y].sum(), items[left_x].sum()
        for value, own, need, other, other_need, count, total in (
            (sure, left_x, need_x, left_y, need_y, items, all_baskets),
            (sure, left_y, need_y, left_x, need_x, baskets, all_items),
        ):
            full, none = own & (need >= total), own & (need <= 0)
            if full.any() or none.any():
                (x if own is left_x else y)[full] = value
                (x if own is left_x else y)[none] = -value
                other_need[other] -= count[full].sum()
                own &= ~(full | none)
                break
        else:
            break
        sure /= 2
    if not (left_x.any() and left_y.any()):
        return x, y
    wx, wy, vx, vy = items[left_x], baskets[left_y], need_x[left_x], need_y[left_y]
    a = np.log(vx / (wy.sum() - vx))
    b = np.log(vy / (wx.sum() - vy))
    a, b = a - np.average(a, weights=wx) / 2, b - np.average(b, weights=wy) / 2
    for _ in range(FIT_STEPS):
        a, at_x = improved(vx, a, wy, b)
        b, at_y = improved(vy, b, wx, a)
        # both sides are measured with the values that the round began with and with those it has made
        if max(np.max(np.abs(at_x - vx) / vx), np.max(np.abs(at_y - vy) / vy)) < FIT_TOLERANCE:
            x[left_x], y[left_y] = a, b
            return x, y
    raise ArithmeticError(f"the null model of {len(n)} frequencies and {len(size)} sizes is not fitted after {FIT_STEPS} rounds")


def fit_null(frequencies: DataFrame, sizes: DataFrame) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """The configuration model of `frequencies`(n, items) and `sizes`(size, baskets).

    Returns ((n, x): the log fitness of items of each frequency, [(size, baskets, y)]). An item and a basket are linked
    with probability sigmoid(x + y). Items of one frequency share x and baskets of one size share y, so the model needs
    the two histograms only, and is exact at any size. The histograms come to the driver: neither can have more rows
    than the square root of twice the links. Up to CELLS cells are fitted there, a larger model by blocks of rows on
    the executors, by the same steps.
    """
    spark = frequencies.sparkSession
    known = [(int(r[0]), int(r[1])) for r in sizes.orderBy("size").collect()]
    per = [(int(r[0]), int(r[1])) for r in frequencies.select("n", "items").orderBy("n").collect()]
    if not known or not per:
        return frequencies.select("n", F.lit(0.0).alias("x")), []
    (n, items), (size, baskets) = zip(*per), zip(*known)
    small = len(per) * len(known) <= CELLS
    x, y = solve(np.array(n), np.array(items), np.array(size), np.array(baskets), _improved if small else _on_executors(spark))
    fitted = spark.createDataFrame(pd.DataFrame({"n": np.array(n, dtype=np.int64), "x": x}), "n long, x double")
    return fitted, [(s, b, float(v)) for (s, b), v in zip(known, y)]


def log_tail(k: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ln P(X >= k) of sums of binomials: X = sum over j of Bin(n[j], q[i, j]), for every row i.

    Saddlepoint approximation of the lattice tail; counts at or below the mean have P of about one half and more,
    which is approximated by the normal law with continuity correction, as no such pair is a surprise.
    """
    k = k.astype(float)
    mean, var = q @ n, (q * (1 - q)) @ n
    out = np.zeros(len(k))
    with np.errstate(all="ignore"):
        z = (k - 0.5 - mean) / np.sqrt(np.maximum(var, 1e-300))
        out = np.where(k <= 0, 0.0, _log_normal_tail(z))
        top = n.sum()
        far = (k - 0.5 > mean + 0.25 * np.sqrt(var)) & (k < top)
        if far.any():
            kk, qq = k[far] - 0.5, q[far]
            t = np.log(np.maximum(kk, 0.5) / np.maximum(mean[far], 1e-300))
            for _ in range(60):
                e = qq * np.exp(t)[:, None]
                p = e / (1 - qq + e)
                step = (p @ n - kk) / np.maximum((p * (1 - p)) @ n, 1e-300)
                t = t - np.clip(step, -1, 1)
                if np.nanmax(np.abs(step)) < 1e-12:
                    break
            cumulant = np.log1p(qq * np.expm1(t)[:, None]) @ n
            e = qq * np.exp(t)[:, None]
            p = e / (1 - qq + e)
            w = np.sqrt(np.maximum(2 * (t * kk - cumulant), 0))
            u = 2 * np.sinh(t / 2) * np.sqrt((p * (1 - p)) @ n)
            sp = _log_normal_tail(w + np.log(u / w) / w)
            out[far] = np.where(np.isfinite(sp), np.minimum(sp, 0.0), out[far])
        every = k >= top
        if every.any():
            out[every] = np.where(k[every] > top, -np.inf, np.log(np.maximum(q[every], 1e-300)) @ n)
    return np.minimum(out, 0.0)


def _log_normal_tail(z: np.ndarray) -> np.ndarray:
    """ln of the upper tail of the standard normal law, also far out."""
    z = np.asarray(z, dtype=float)
    near = np.array([0.5 * math.erfc(v / math.sqrt(2)) if v < 20 else 1.0 for v in z])
    far = -z * z / 2 - np.log(np.maximum(z, 1) * math.sqrt(2 * math.pi)) + np.log1p(-1 / np.maximum(z, 1) ** 2 + 3 / np.maximum(z, 1) ** 4)
    return np.where(z < 20, np.log(near), far)


def surprise(pairs: DataFrame, model: list[tuple[int, int, float]]) -> DataFrame:
    """`pairs`(item_a, item_b, n_ab, n_a, n_b, x_a, x_b) with expected, ratio and log_p = ln P(count >= n_ab).

    Pairs of the same counts are judged once in each batch, and no more than CELLS cells of pairs x sizes are held.
    """
    n = np.array([float(b) for _, b, _ in model])
    y = np.array([v for _, _, v in model])
    shared = pairs.sparkSession.sparkContext.broadcast((n, y))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, y = shared.value
        for frame in frames:
            low, high = np.minimum(frame["x_a"], frame["x_b"]), np.maximum(frame["x_a"], frame["x_b"])
            once, back = np.unique(np.stack([frame["n_ab"].to_numpy(dtype=float), low, high], axis=1), axis=0, return_inverse=True)
            expected, log_p = np.empty(len(once)), np.empty(len(once))
            for part in _chunks(len(once), len(y)):
                q = _sigmoid(once[part, 1, None] + y) * _sigmoid(once[part, 2, None] + y)
                expected[part] = q @ n
                log_p[part] = log_tail(once[part, 0], q, n)
            frame["expected"], frame["log_p"] = expected[back.ravel()], log_p[back.ravel()]
            yield frame

    schema = T.StructType([*pairs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("expected", "log_p"))])
    return pairs.mapInPandas(judge, schema).withColumn("ratio", F.col("n_ab") / F.col("expected"))


def control_discoveries(tested: DataFrame, tests: int, block: int = RANK_BLOCK) -> DataFrame:
    """Adds `log_q`: ln of the Benjamini-Hochberg adjusted p-value over `tests` tests.

    Pairs that never come together have p = 1 and need no row. Rows are ranked in the order of (log_p, item_a, item_b)
    by ranges, so that no value of log_p, however common, meets in one task; equal values end with the adjusted value of
    the last of them. The smallest later value is taken within blocks of ranks and over one row for each block.
    """
    ranked = global_index(tested, [F.col("log_p"), F.col("item_a"), F.col("item_b")], "_i")
    raw = F.col("log_p") + F.ln(F.lit(float(max(tests, 1)))) - F.ln(F.col("_i") + 1)
    ranked = ranked.withColumn("_raw", raw).withColumn("_block", F.floor(F.col("_i") / block))
    low = ranked.groupBy("_block").agg(F.min("_raw").alias("_m"))
    # one row for each `block` pairs
    after = low.select("_block", F.min("_m").over(W.orderBy("_block").rowsBetween(1, W.unboundedFollowing)).alias("_later"))
    down = W.partitionBy("_block").orderBy("_i").rowsBetween(0, W.unboundedFollowing)
    adjusted = ranked.withColumn("_least", F.min("_raw").over(down)).join(F.broadcast(after), "_block")
    return adjusted.withColumn("log_q", F.least("_least", "_later", F.lit(0.0))).drop("_i", "_raw", "_block", "_least", "_later")


def pair_surprise(lists: DataFrame, least: int = 1) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, expected, ratio, log_p, log_q) of every pair that occurs together in at least
    `least` baskets.

    `lists` has `items` (array without repeats or nulls), `others` and `size` as `baskets_of` gives them. `n` is the
    number of baskets. The discoveries are controlled over all pairs of items, whatever `least` is; over billions of
    records set it to what is worth a row, as there are as many rows as pairs. Items that are in every basket have
    expectation and ratio as any other. An empty input has no pairs; a basket of one item counts for its item and its
    size only.
    """
    lists = cut(lists)
    # a basket in one piece is one row; of a basket in pieces, the rows (i, i) hold each item once
    whole = lists.filter(F.col("others").isNull())
    items = cut(whole.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")))
    members = whole.groupBy("size").agg(F.sum(F.size("items")).alias("links"))
    sizes = members.filter("size > 0").select("size", F.round(F.col("links") / F.col("size")).cast("long").alias("baskets"))
    x, model = fit_null(items.groupBy("n").agg(F.count("*").alias("items")), sizes)
    # one row for each different frequency: at most the square root of twice the links
    fitted = items.join(F.broadcast(x), "n")
    n_items = items.count()
    n_baskets = sum(b for _, b, _ in model)
    side = lambda s: fitted.select(F.col("item").alias(f"item_{s}"), F.col("n").alias(f"n_{s}"), F.col("x").alias(f"x_{s}"))
    pairs = count_pairs(lists).filter(F.col("n_ab") >= least).join(side("a"), "item_a").join(side("b"), "item_b")
    out = control_discoveries(surprise(pairs, model), n_items * (n_items - 1) // 2)
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n_baskets).cast("long").alias("n"), "expected", "ratio", "log_p", "log_q")
