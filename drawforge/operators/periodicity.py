"""Periodicity of each ball: autocorrelation and Fourier peaks of its 0/1 series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import spread
from ..schema import BALLS, MAX_BALL
from ..session import cut
from .frequency import ball_domain
from .views import by_blocks, occurrences


#: Longest series that one task transforms, about 250 MB; longer ones are split over tasks.
SERIES_LIMIT = 10_000_000


def _length(ordered: DataFrame) -> DataFrame:
    return F.broadcast(ordered.agg(F.count("*").alias("n")))  # one row


def binary_series(ordered: DataFrame) -> DataFrame:
    """(ball, n, hits): length and sum of each ball's 0/1 series."""
    seen = occurrences(ordered, "di").select("ball", "di").distinct()
    per = seen.groupBy("ball").agg(F.count("*").alias("hits"))
    return ball_domain(ordered).join(per, "ball", "left").join(_length(ordered)).select("ball", "n", F.coalesce("hits", F.lit(0)).alias("hits"))


def ball_series(ordered: DataFrame) -> DataFrame:
    """(ball, di, hit): the 0/1 series of every ball, 49 rows a draw, made within the draw's row."""
    drawn = F.array(*BALLS)
    all_ = F.transform(F.sequence(F.lit(1), F.lit(MAX_BALL)), lambda b: F.struct(b.cast("int").alias("ball"), F.coalesce(F.array_contains(drawn, b), F.lit(False)).cast("int").alias("hit")))
    return ordered.select("di", F.explode(all_).alias("x")).select("x.ball", "di", "x.hit")


def acf(ordered: DataFrame, max_lags: int = 50) -> DataFrame:
    """(ball, lag, r) for lags 0 to min(n / 2, 50) - 1: mean product of deviations at the lag, over the variance.

    Only hits are compared: a draw meets the draws up to `max_lags` later that it has a ball in common with, within
    blocks of draws with a halo. Sums at both ends of the series come from the hits there. A constant series has r = 0
    at every lag. An empty input has no rows.
    """
    hits = occurrences(ordered, "di").select("di", "ball").distinct()
    sets = ordered.select("di", F.array_distinct(F.array_compact(F.array(*BALLS))).alias("balls"))

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("di", kind="stable")
        di = frame["di"].to_numpy()
        own = di >= int(frame["block"].iloc[0]) * 4096
        x = np.zeros((len(di), MAX_BALL + 1), dtype=np.int32)
        many = [len(b) for b in frame["balls"]]
        x[np.repeat(np.arange(len(di)), many), np.concatenate([*frame["balls"], np.zeros(0)]).astype(int)] = 1
        out = []
        for lag in range(1, max_lags):
            here = np.flatnonzero(own & (np.arange(len(di)) >= lag))
            both = (x[here] * x[here - lag]).sum(axis=0)
            out += [(b, lag, int(c)) for b, c in enumerate(both) if c]
        return pd.DataFrame(out, columns=["ball", "lag", "c"])

    blocks = by_blocks(sets, max_lags, 4096)
    common = spread(blocks, "block").groupBy("block").applyInPandas(pairs, "ball int, lag int, c long").groupBy("ball", "lag").agg(F.sum("c").alias("c"))
    per = hits.groupBy("ball").agg(F.count("*").alias("h"))
    n = _length(ordered)
    lags = ordered.sparkSession.range(max_lags).select(F.col("id").cast("int").alias("lag"))
    cells = ball_domain(ordered).join(F.broadcast(lags)).join(n)
    cells = cells.filter(F.col("lag") < F.least(F.floor(F.col("n") / 2), F.lit(max_lags)))
    # hits among the last and the first `lag` draws: at most max_lags draws at each end
    near = hits.join(n).filter((F.col("di") < max_lags) | (F.col("di") >= F.col("n") - max_lags))
    ends = near.join(F.broadcast(lags), (F.col("di") < F.col("lag")) | (F.col("di") >= F.col("n") - F.col("lag")))
    ends = ends.groupBy("ball", "lag").agg(
        F.count_if(F.col("di") >= F.col("n") - F.col("lag")).alias("tail"), F.count_if(F.col("di") < F.col("lag")).alias("head")
    )
    all_ = cells.join(per, "ball", "left").join(common, ["ball", "lag"], "left").join(ends, ["ball", "lag"], "left").fillna(0, ["h", "c", "tail", "head"])
    m = F.col("h") / F.col("n")
    k = F.col("n") - F.col("lag")
    # sum over pairs of (x - m)(y - m), x without the last and y without the first `lag` draws
    top = F.col("c") - m * ((F.col("h") - F.col("tail")) + (F.col("h") - F.col("head"))) + k * m * m
    var = m * (1 - m)
    r = F.when(var < 1e-12, 0.0).when(F.col("lag") == 0, 1.0).otherwise(top / k / var)
    return all_.select("ball", "lag", r.alias("r"))


def _split_peaks(hits: DataFrame, n: int, top: int) -> DataFrame:
    """The rows of `dft_peaks` where no task holds a whole series.

    Bluestein's form makes the transform of length n a circular convolution with a chirp, of length n1 * n2, a power
    of two from 2 n - 1 on. Both of its transforms take four steps: columns of places that are equal modulo n1, twiddle
    factors, regrouping, rows. The rows of the first are the columns of the inverse, so blocks are shuffled twice. A task
    holds a band of `width` columns or rows of one ball. The threshold comes from sums over all bands.
    """
    bits = (2 * n - 2).bit_length()
    n1, n2 = 1 << (bits + 1) // 2, 1 << bits // 2
    size, width = n1 * n2, min(64, n2)
    tasks = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chirp(t: np.ndarray, sign: int) -> np.ndarray:
        """exp(sign i pi t^2 / n); t^2 modulo 2 n in parts, so that 64 bits hold it."""
        m = 2 * n
        square = ((t >> 16) * t % m * 65536 + (t & 65535) * t) % m
        return np.exp(sign * 1j * np.pi * square / n)

    def blocks(ball: int, band: int, full: np.ndarray) -> pd.DataFrame:
        """`full` (width columns, all rows) cut into blocks for the bands of rows."""
        cuts = range(0, full.shape[1], width)
        return pd.DataFrame(
            {"ball": ball, "band": [c // width for c in cuts], "part": band, "block": [full[:, c : c + width].tobytes() for c in cuts]}
        )

    def joined(frame: pd.DataFrame, length: int) -> np.ndarray:
        """Rows of a band (width, length) from its blocks; a missing block is 0."""
        full = np.zeros((width, length), dtype=complex)
        for part, block in zip(frame["part"], frame["block"]):
            full[:, part * width : (part + 1) * width] = np.frombuffer(block, dtype=complex).reshape(width, width).T
        return full

    def columns(ball: int, band: int, x: np.ndarray) -> pd.DataFrame:
        own = np.arange(band * width, (band + 1) * width)
        return blocks(ball, band, np.fft.fft(x, axis=1) * np.exp(-2j * np.pi * np.outer(own, np.arange(n2)) / size))

    def series(frame: pd.DataFrame) -> pd.DataFrame:
        band, t = int(frame["band"].iloc[0]), frame["t"].to_numpy()
        x = np.zeros((width, n2), dtype=complex)
        x[t % n1 - band * width, t // n1] = chirp(t, -1)
        return columns(int(frame["ball"].iloc[0]), band, x)

    def chirps(frames):
        for frame in frames:
            for band in frame["band"]:
                at = np.arange(band * width, (band + 1) * width)[:, None] + n1 * np.arange(n2)
                u = np.minimum(at, size - at)
                yield columns(0, int(band), np.where(u < n, chirp(np.where(u < n, u, 0), 1), 0))

    def chirp_rows(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"band": frame["band"].iloc[:1], "part": -1, "block": [np.fft.fft(joined(frame, n1), axis=1).tobytes()]})

    def convolved(frame: pd.DataFrame) -> pd.DataFrame:
        band, own = int(frame["band"].iloc[0]), frame["part"] >= 0
        other = np.frombuffer(frame.loc[~own, "block"].iloc[0], dtype=complex).reshape(width, n1)
        rows = np.fft.ifft(np.fft.fft(joined(frame[own], n1), axis=1) * other, axis=1)
        k = np.arange(band * width, (band + 1) * width)
        return blocks(int(frame["ball"].iloc[0]), band, rows * np.exp(2j * np.pi * np.outer(k, np.arange(n1)) / size))

    def bins(frame: pd.DataFrame) -> pd.DataFrame:
        at = int(frame["band"].iloc[0]) * width
        mag = np.abs(np.fft.ifft(joined(frame, n2), axis=1)).ravel()
        k = (np.arange(at, at + width)[:, None] + n1 * np.arange(n2)).ravel()
        mag, k = mag[(k > 0) & (k <= n // 2)], k[(k > 0) & (k <= n // 2)]
        sums = (len(mag), mag.sum(), ((mag - mag.mean()) ** 2).sum()) if len(mag) else (0, 0.0, 0.0)
        may = (n >= 5 * k) & (k >= 2)
        mag, k = mag[may], k[may]
        best = np.lexsort((k, -np.round(mag, 9)))[:top]
        return pd.DataFrame({"ball": frame["ball"].iloc[0], "c": [sums[0]], "s": [sums[1]], "d": [sums[2]], "ks": [k[best]], "mags": [mag[best]]})

    def grouped(df: DataFrame):
        return df.repartition(tasks, "ball", "band").groupBy("ball", "band")

    form = "ball int, band long, part long, block binary"
    hit_bands = hits.withColumn("band", F.floor(F.col("t") % n1 / width).cast("long"))
    made = grouped(hit_bands).applyInPandas(series, form)
    bands = hits.sparkSession.range(0, n1 // width, 1, tasks).select(F.col("id").alias("band"))
    chirp_bands = grouped(bands.mapInPandas(chirps, form)).applyInPandas(chirp_rows, "band long, part long, block binary")
    balls = F.broadcast(hits.select("ball").distinct())
    all_ = made.unionByName(chirp_bands.crossJoin(balls).select("ball", "band", "part", "block"))
    found = cut(grouped(grouped(all_).applyInPandas(convolved, form)).applyInPandas(bins, "ball int, c long, s double, d double, ks array<long>, mags array<double>"))
    per = found.groupBy("ball").agg(F.sum("c").alias("n_bins"), (F.sum("s") / F.sum("c")).alias("mean"))
    # deviations within the bands and between them
    parts = found.filter("c > 0").join(F.broadcast(per), "ball")
    between = F.col("c") * F.pow(F.col("s") / F.col("c") - F.col("mean"), 2)
    least = parts.groupBy("ball").agg((F.first("mean") + 2 * F.sqrt(F.sum(F.col("d") + between) / F.first("n_bins"))).alias("least"))
    each = found.select("ball", F.explode(F.arrays_zip("ks", "mags")).alias("x")).select("ball", F.col("x.ks").alias("k"), F.col("x.mags").alias("magnitude"))
    order = W.partitionBy("ball").orderBy(F.desc(F.round("magnitude", 9)), "k")  # `top` rows a band
    ranked = each.join(F.broadcast(least), "ball").filter("magnitude > least").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("ball", "k", F.rint(F.lit(n) / F.col("k")).cast("long").alias("period"), "magnitude", "rank")


def dft_peaks(ordered: DataFrame, longest: int | None = None, top: int = 5) -> DataFrame:
    """(ball, k, period, magnitude, rank) of the strongest frequencies of every ball's series.

    A peak is above the mean plus two deviations of all bins, with a period n / k between 5 and n / 2, rounded half
    to even. One task transforms one ball's series by fast Fourier transform; series beyond SERIES_LIMIT are split
    over tasks (`_split_peaks`). `longest` takes the last draws only; None takes all. Fewer than ten draws have no rows.
    """
    n_all = ordered.agg(F.count("*")).first()[0]
    n = n_all if longest is None else min(n_all, longest)
    start = n_all - n
    hits = occurrences(ordered.filter(F.col("di") >= start), "di").select("ball", (F.col("di") - start).alias("t")).distinct()
    if n > SERIES_LIMIT:
        return _split_peaks(hits, n, top)

    def peaks(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(n)
        x[frame["t"].to_numpy()] = 1.0
        mag = np.abs(np.fft.rfft(x - x.mean()))
        mag[0] = 0.0
        least = mag[1:].mean() + 2 * mag[1:].std() if n > 4 else 0.0
        k = np.flatnonzero(mag > least)
        k = k[(k > 0) & (n >= 5 * k) & (k >= 2)]
        order = k[np.lexsort((k, -np.round(mag[k], 9)))][:top]
        return pd.DataFrame(
            {"ball": frame["ball"].iloc[0], "k": order, "period": np.rint(n / order).astype(int), "magnitude": mag[order], "rank": np.arange(1, len(order) + 1)}
        )

    return spread(hits, "ball").groupBy("ball").applyInPandas(peaks, "ball int, k long, period long, magnitude double, rank long")


def summary(ordered: DataFrame) -> DataFrame:
    """(ball, rate, n_lags, n_periods, lags, periods, cyclic, rank): significant lags and periods of each ball.

    `lags` are the first ten significant ones, `periods` those of the three strongest peaks, both as text.

    A lag is significant if |r| > 1.96 / sqrt(n). A ball with both is cyclic; cyclic balls are ranked by the number
    of both, the smaller ball first. Fewer than 20 draws have no rows.
    """
    n = _length(ordered)
    r = acf(ordered).filter("lag >= 1").join(n)
    lags = r.filter(F.abs("r") > F.lit(1.96) / F.sqrt("n")).groupBy("ball")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    # at most 49 lags and five periods a ball
    lags = lags.agg(F.count("*").alias("n_lags"), text(F.slice(F.sort_array(F.collect_list("lag")), 1, 10)).alias("lags"))
    ranked = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("rank", "period"))), 1, 3), lambda x: x["period"])
    periods = dft_peaks(ordered).groupBy("ball").agg(F.count("*").alias("n_periods"), text(ranked).alias("periods"))
    base = binary_series(ordered).filter("n >= 20").select("ball", (F.col("hits") / F.col("n")).alias("rate"))
    all_ = base.join(lags, "ball", "left").join(periods, "ball", "left").fillna(0, ["n_lags", "n_periods"]).fillna("", ["lags", "periods"])
    all_ = all_.withColumn("cyclic", (F.col("n_lags") > 0) & (F.col("n_periods") > 0))
    score = F.least("n_lags", F.lit(5)) + F.least("n_periods", F.lit(5))
    rank = F.when(F.col("cyclic"), F.row_number().over(W.partitionBy("cyclic").orderBy(F.desc(score), "ball")))
    return all_.select("ball", "rate", "n_lags", "n_periods", "lags", "periods", "cyclic", rank.alias("rank"))


def verdict(summary: DataFrame, draws: int) -> str:
    """One line on the balls that a summary finds cyclic."""
    n = summary.filter("cyclic").count()
    return f"{n} numéro(s) cyclique(s) détecté(s) sur {draws} tirages." if n else "Aucun cycle significatif : compatible avec du bruit blanc."
