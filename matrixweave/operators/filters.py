"""Ridge filters and threshold segmentation of images; tiles with a halo are filtered in tasks of their own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixweave.operators import graph
from matrixweave.operators.geometry import by_sample
from matrixweave.operators.thresholds import thresholds
from matrixweave.plans.scratch import written
from matrixweave.sources.images import with_halo

TILE, REACH = 128, 4


def _smooth(image: np.ndarray, sigma: float, order: tuple[int, int]) -> np.ndarray:
    """Gaussian derivatives along both axes, with mirrored edges."""
    r = int(REACH * sigma + 0.5)
    t = np.arange(-r, r + 1)
    g = np.exp(-(t**2) / (2 * sigma**2))
    g /= g.sum()
    kernels = {0: g, 1: -t / sigma**2 * g, 2: (t**2 / sigma**4 - 1 / sigma**2) * g}
    for axis, n in enumerate(order):
        image = np.apply_along_axis(lambda row: np.convolve(np.pad(row, r, mode="symmetric"), kernels[n][::-1], "valid"), axis, image)  # noqa: B023
    return image


def ridges(image: np.ndarray, sigmas: tuple[float, ...] = (1, 3), method: str = "sato") -> np.ndarray:
    """Bright ridges over all scales: the second derivative across them (sato), or its share of the whole curvature (frangi)."""
    out = np.zeros_like(image, dtype=float)
    for s in sigmas:
        yy, xx, xy = (_smooth(image.astype(float), s, o) * s**2 for o in ((2, 0), (0, 2), (1, 1)))
        gap = np.sqrt(((yy - xx) / 2) ** 2 + xy**2)
        a, b = (yy + xx) / 2 + gap, (yy + xx) / 2 - gap
        small, large = np.where(np.abs(a) < np.abs(b), a, b), np.where(np.abs(a) < np.abs(b), b, a)
        if method == "sato":
            v = np.maximum(-np.minimum(a, b), 0)
        else:
            size = np.sqrt(small**2 + large**2)
            top = size.max() / 2 or 1.0
            v = np.where(large < 0, np.exp(-((small / np.where(large == 0, 1, large)) ** 2) / 0.5) * (1 - np.exp(-(size**2) / (2 * top**2))), 0)
        out = np.maximum(out, v)
    return out


def ridge_filter(pixels: DataFrame, sigmas: tuple[float, ...] = (1, 3), method: str = "sato", tile: int = TILE) -> DataFrame:
    """``pixels`` with v filtered; missing pixels of a tile count as 0.  Frangi's contrast is that of the tile."""
    halo = int(REACH * max(sigmas) + 1)

    def build(key: tuple, t: dict[str, np.ndarray]) -> list[tuple]:
        y0, x0 = int(t["y"].min()), int(t["x"].min())
        image = np.zeros((int(t["y"].max()) - y0 + 1, int(t["x"].max()) - x0 + 1))
        image[t["y"] - y0, t["x"] - x0] = t["v"]
        found = ridges(image, sigmas, method)
        return [(key[0], key[1], int(y), int(x), float(found[y - y0, x - x0])) for y, x, own in zip(t["y"], t["x"], t["inner"]) if own]

    rows = with_halo(pixels.select(*[F.col(c).cast("long").alias(c) for c in ("sample_id", "channel", "y", "x")], F.col("v").cast("double").alias("v")), tile, halo)
    return by_sample(rows.withColumn("inner", F.col("inner").cast("int")), ["sample_id", "channel", "ty", "tx"], build, "sample_id long, channel long, y long, x long, v double")


def segment(pixels: DataFrame, method: str = "otsu", least: int = 5) -> DataFrame:
    """(sample_id, y, x, label) of connected pixels over the channel's threshold; areas under ``least`` go, labels count from 1 by first pixel.

    A plain substitute for a learned segmenter; pixels of several channels are taken together.
    """
    bright = pixels.join(thresholds(pixels, method), ["sample_id", "channel"]).where(F.col("v") > F.col("threshold")).select("sample_id", "y", "x").distinct()
    wide = F.max("x").over(Window.partitionBy("sample_id")) + 2
    bright = written(bright.withColumn("_w", wide).select("sample_id", "y", "x", (F.col("y").cast("long") * F.col("_w") + F.col("x")).alias("id")), "bright")
    there = bright.select("sample_id", F.col("id").alias("dst"), "y", "x")
    steps = F.explode(F.array(F.struct(F.lit(0).alias("dy"), F.lit(1).alias("dx")), F.struct(F.lit(1).alias("dy"), F.lit(0).alias("dx"))))
    edges = bright.withColumn("s", steps).select("sample_id", F.col("id").alias("src"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).join(there, ["sample_id", "y", "x"]).select("sample_id", "src", "dst")
    groups = written(graph.components(bright, edges), "segments")
    sizes = groups.groupBy("sample_id", "component").count().where(F.col("count") >= least)
    rank = sizes.withColumn("label", F.row_number().over(Window.partitionBy("sample_id").orderBy("component"))).select("sample_id", "component", "label")
    return bright.join(groups, ["sample_id", "id"]).join(rank, ["sample_id", "component"]).select("sample_id", "y", "x", "label")
