"""Intensity thresholds per channel from histograms: pixels are counted in Spark, and a channel's 256 counts decide."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixweave.operators.geometry import by_sample

BINS, LEAST_PIXELS = 256, 10


def otsu(centre: np.ndarray, count: np.ndarray) -> float:
    """The split of largest variance between the classes."""
    w = np.cumsum(count)
    m = np.cumsum(count * centre)
    low, high = w[:-1], w[-1] - w[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = low * high * (m[:-1] / low - (m[-1] - m[:-1]) / high) ** 2
    return float(centre[int(np.nanargmax(between))])


def yen(centre: np.ndarray, count: np.ndarray) -> float:
    """The split of largest correlation."""
    p = count / count.sum()
    below, squares = np.cumsum(p), np.cumsum(p**2)
    above = np.cumsum(p[::-1] ** 2)[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.log((below[:-1] * (1 - below[:-1])) ** 2 / (squares[:-1] * above[1:]))
    return float(centre[int(np.nanargmax(np.where(np.isfinite(score), score, np.nan)))])


def triangle(centre: np.ndarray, count: np.ndarray) -> float:
    """The bin farthest below the line from the peak to the longer tail's end."""
    peak, used = int(count.argmax()), np.flatnonzero(count)
    low, high = int(used[0]), int(used[-1])
    end = low if peak - low > high - peak else high
    if end == peak:
        return float(centre[peak])
    step = 1 if end > peak else -1
    at = np.arange(peak, end + step, step)
    line = count[peak] + (count[end] - count[peak]) * (at - peak) / (end - peak)
    return float(centre[int(at[(line - count[at]).argmax()])])


def li(centre: np.ndarray, count: np.ndarray) -> float:
    """Least cross entropy, by iteration from the mean."""
    shift = min(0.0, float(centre[0]) - 1e-9) - 1e-9
    v = centre - shift
    t = float((v * count).sum() / count.sum())
    for _ in range(1000):
        back, fore = v <= t, v > t
        if not count[fore].sum() or not count[back].sum():
            break
        a, b = (float((v[s] * count[s]).sum() / count[s].sum()) for s in (back, fore))
        after = (a - b) / (np.log(a) - np.log(b)) if a != b else a
        if abs(after - t) < 1e-9:
            break
        t = after
    return t + shift


METHODS = {"li": li, "otsu": otsu, "triangle": triangle, "yen": yen}


def thresholds(pixels: DataFrame, method: str = "otsu") -> DataFrame:
    """(sample_id, channel, threshold) over the positive pixels; channels of fewer than ten have none, constant ones their value."""
    if method not in METHODS:
        raise ValueError(f"thresholds are {', '.join(METHODS)}, not {method!r}")
    find = METHODS[method]
    own = pixels.where("v > 0")
    span = own.groupBy("sample_id", "channel").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).where(F.col("n") >= LEAST_PIXELS)
    level = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))).otherwise(0)
    counts = own.join(span, ["sample_id", "channel"]).groupBy(F.col("sample_id").cast("long").alias("sample_id"), F.col("channel").cast("long").alias("channel"), "lo", "hi", level.cast("long").alias("bin")).agg(F.count("*").alias("n"))

    def build(key: tuple, t: dict[str, np.ndarray]) -> list[tuple]:
        lo, hi = float(t["lo"][0]), float(t["hi"][0])
        if hi <= lo:
            return [(*key, lo)]
        count = np.zeros(BINS)
        count[t["bin"]] = t["n"]
        return [(*key, find(lo + (np.arange(BINS) + 0.5) * (hi - lo) / BINS, count))]

    return by_sample(counts, ["sample_id", "channel"], build, "sample_id long, channel long, threshold double")


def adaptive_signal(rows: DataFrame, cuts: DataFrame, least: float = 0.1) -> DataFrame:
    """(sample_id, by, bx) of blocks in which more than ``least`` of some channel's pixels are over its threshold."""
    share = rows.join(F.broadcast(cuts), ["sample_id", "channel"]).groupBy("sample_id", "channel", "by", "bx").agg(F.avg((F.col("v") > F.col("threshold")).cast("double")).alias("s"))
    return share.where(F.col("s") > least).select("sample_id", "by", "bx").distinct()
