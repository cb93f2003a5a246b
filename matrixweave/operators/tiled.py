"""Segmentation of large images by tiles with a halo, without a mask of the whole image."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixweave.operators.geometry import by_sample
from matrixweave.operators.thresholds import thresholds
from matrixweave.sources.images import with_halo

#: A tile whose mean is under this share of the image's largest value is skipped: fixed value.
DARK = 0.01


def regions(bright: np.ndarray) -> np.ndarray:
    """(area, sum of y, sum of x) of each set of bright pixels that touch by their sides."""
    padded = np.zeros((bright.shape[0], bright.shape[1] + 2), np.int8)
    padded[:, 1:-1] = bright
    turn = np.diff(padded, axis=1)
    row, start = np.nonzero(turn == 1)
    end = np.nonzero(turn == -1)[1]  # runs of a row, left to right, in the order of their rows
    parent = np.arange(len(row))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(bright.shape[0] + 1))
    for y in range(1, bright.shape[0]):
        a, a_end, b, b_end = first[y - 1], first[y], first[y], first[y + 1]
        while a < a_end and b < b_end:
            if start[a] < end[b] and start[b] < end[a]:
                i, j = find(a), find(b)
                parent[max(i, j)] = min(i, j)
            if end[a] < end[b]:
                a += 1
            else:
                b += 1
    root = np.array([find(i) for i in range(len(row))], np.int64)
    n = end - start
    out = np.zeros((len(row), 3), np.int64)
    for k, v in enumerate((n, n * row, n * (start + end - 1) // 2)):
        np.add.at(out[:, k], root, v)
    return out[root == np.arange(len(row))]


def segment_tiled(pixels: DataFrame, tile: int = 2048, overlap: int = 128, method: str = "otsu", least: int = 5, um: float = 1.0) -> DataFrame:
    """(sample_id, channel, ty, tx, y, x, area, y_um, x_um): a row for each region over the channel's threshold, at its centre.

    A region is the tile's that its centre lies in, which sees it whole if it is no wider
    and no higher than ``overlap``; areas under ``least`` go.  A plain substitute for a
    learned segmenter.  A task holds one tile and its halo.
    """

    def build(key: tuple, t: dict[str, np.ndarray]) -> list[tuple]:
        sample, channel, ty, tx = key
        if t["v"].mean() < DARK * t["top"][0]:
            return []
        y0, x0 = int(t["y"].min()), int(t["x"].min())
        bright = np.zeros((int(t["y"].max()) - y0 + 1, int(t["x"].max()) - x0 + 1), bool)
        bright[t["y"] - y0, t["x"] - x0] = t["v"] > t["threshold"]
        out = []
        for area, sy, sx in regions(bright).tolist():
            cy, cx = (sy + area * y0) / area, (sx + area * x0) / area
            if area >= least and cy // tile == ty and cx // tile == tx:
                out.append((sample, channel, ty, tx, cy, cx, area, cy * um, cx * um))
        return out

    cuts = thresholds(pixels, method).select("sample_id", "channel", "threshold")
    top = pixels.groupBy("sample_id", "channel").agg(F.max("v").alias("top"))
    rows = with_halo(pixels, tile, overlap).join(cuts.join(top, ["sample_id", "channel"]), ["sample_id", "channel"])
    rows = rows.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("channel").cast("long").alias("channel"), "ty", "tx", "y", "x", "v", "threshold", "top")
    return by_sample(rows, ["sample_id", "channel", "ty", "tx"], build, "sample_id long, channel long, ty int, tx int, y double, x double, area long, y_um double, x_um double")
