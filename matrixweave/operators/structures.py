"""Structures: cells of marked clusters grouped in space, and their shape features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixweave.operators import graph
from matrixweave.operators.geometry import by_sample, hull
from matrixweave.operators.spatial import radius_edges
from matrixweave.plans.scratch import written

SECTORS, NEAR = 18, 3


def marker_columns(columns: list[str], markers: list[str]) -> list[str]:
    """The first column that holds each marker's name, in any case; an unknown marker is an error."""
    out = []
    for m in markers:
        hit = [c for c in columns if m.lower() in c.lower()]
        if not hit:
            raise KeyError(f"no column holds the marker {m!r}")
        out.append(hit[0])
    return out


def annotate(cells: DataFrame, markers: list[str], n_top: int = 1, radius: float = 50.0, least: int = 5) -> DataFrame:
    """``cells(sample_id, id, cluster, x, y, …)`` with structure: whether a cell is in one of the ``n_top`` clusters of highest mean marker sum, and in a component of at least ``least`` such cells."""
    own = marker_columns(cells.columns, markers)
    means = cells.groupBy("cluster").agg(F.avg(sum((F.col(c) for c in own), F.lit(0.0))).alias("_m"))
    top = means.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_m"), "cluster"))).where(F.col("_r") <= n_top).select("cluster")
    picked = written(cells.join(F.broadcast(top), "cluster", "left_semi").select("sample_id", "id", "x", "y"), "picked")
    groups = graph.components(picked, radius_edges(picked, radius))
    size = F.count("*").over(Window.partitionBy("sample_id", "component"))
    big = groups.withColumn("_n", size).where(F.col("_n") >= least).select("sample_id", "id", F.lit(True).alias("structure"))
    return cells.join(big, ["sample_id", "id"], "left").withColumn("structure", F.coalesce("structure", F.lit(False)))


def split(cells: DataFrame, name: str = "structure", radius: float = 50.0, least: int = 5) -> DataFrame:
    """``cells(sample_id, id, x, y)`` of one structure with uid ``{sample}_{name}{NN}`` by first member; smaller groups than ``least`` have none."""
    groups = graph.components(cells, radius_edges(cells, radius))
    sizes = groups.groupBy("sample_id", "component").count().where(F.col("count") >= least)
    rank = sizes.withColumn("_i", F.row_number().over(Window.partitionBy("sample_id").orderBy("component")) - 1)
    uid = F.format_string(f"%s_{name}%02d", F.col("sample_id").cast("string"), F.col("_i"))
    out = groups.join(rank.select("sample_id", "component", uid.alias("uid")), ["sample_id", "component"], "left")
    return cells.join(out.select("sample_id", "id", "uid"), ["sample_id", "id"], "left")


def shape_features(points: DataFrame, least: int = 5) -> DataFrame:
    """Per structure of ``points(sample_id, uid, x, y, flag)``: shape, angular coverage and three-neighbour graph measures; structures under ``least`` points have none."""
    names = ["n", "log_area", "circularity", "solidity", "max_gap", "gap_entropy", "flag_share", "n_components", "largest_share", "degree_entropy", "assortativity"]

    def build(key: tuple, t: dict[str, np.ndarray]) -> list[tuple]:
        xy = np.column_stack([t["x"], t["y"]]).astype(float)
        order = np.lexsort(xy.T)
        xy, flag = xy[order], t["flag"][order].astype(float)
        n = len(xy)
        if n < least:
            return []
        corners = hull(xy)
        nxt = np.roll(corners, -1, axis=0)
        area = abs(float((corners[:, 0] * nxt[:, 1] - corners[:, 1] * nxt[:, 0]).sum())) / 2
        around = float(np.sqrt(((corners - nxt) ** 2).sum(axis=1)).sum())
        box = float(np.prod(np.ptp(xy, axis=0)))
        angle = np.sort(np.arctan2(*(xy - xy.mean(axis=0)).T[::-1]))
        gaps = np.diff(np.append(angle, angle[0] + 2 * np.pi))
        entropy = lambda c: float(-(c[c > 0] / c.sum() * np.log(c[c > 0] / c.sum())).sum())
        d = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, : min(NEAR, n - 1)]
        edges = {tuple(sorted((i, int(j)))) for i in range(n) for j in near[i]}
        parent = list(range(n))

        def find(i: int) -> int:
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in edges:
            parent[find(a)] = find(b)
        sizes = np.unique([find(i) for i in range(n)], return_counts=True)[1]
        degree = np.bincount(np.array(list(edges)).reshape(-1), minlength=n)
        ends = np.array([(a, b) for a, b in edges] + [(b, a) for a, b in edges])
        p, q = flag[ends[:, 0]], flag[ends[:, 1]]
        mixing = float(np.corrcoef(p, q)[0, 1]) if len(edges) >= 4 and p.std() > 0 and q.std() > 0 else 0.0
        sector = np.histogram(angle, bins=SECTORS, range=(-np.pi, np.pi))[0].astype(float)
        return [(*key, n, float(np.log1p(area)), 4 * np.pi * area / around**2 if around else 0.0, area / box if box else 0.0, float(gaps.max()), entropy(sector), float(flag.mean()), len(sizes), float(sizes.max() / n), entropy(np.bincount(degree).astype(float)), mixing)]

    kinds = {"n": "int", "n_components": "int"}
    schema = "sample_id long, uid string, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in names)
    own = points.select(F.col("sample_id").cast("long").alias("sample_id"), "uid", "x", "y", F.col("flag").cast("double").alias("flag"))
    return by_sample(own.where("uid is not null"), ["sample_id", "uid"], build, schema)


#: The length that a border pixel adds, by the pattern of its border neighbours (a side counts 2, a corner 10, the pixel 1).
SIDE, CORNER = 2, 10
BORDER = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: 2**0.5, 33: 2**0.5, 13: (1 + 2**0.5) / 2, 23: (1 + 2**0.5) / 2}
FEATURES_11 = ("log_area_norm", "max_gap", "peri_coverage", "peri_frac", "circularity", "solidity", "n_components_norm", "largest_share", "degree_entropy", "assortativity", "gap_entropy")


def region_shape(pixels: np.ndarray) -> tuple[float, float, float, np.ndarray]:
    """(area, perimeter, solidity, centroid) of distinct pixels (y, x); the hull is that of the pixels' side centres, and pixels in it are counted."""
    low = pixels.min(axis=0) - 1
    on = np.zeros(np.ptp(pixels, axis=0) + 3, bool)
    on[tuple((pixels - low).T)] = True
    moved = lambda m, dy, dx: np.roll(m, (dy, dx), axis=(0, 1))  # noqa: E731  the margin is empty
    sides, corners = [(0, 1), (0, -1), (1, 0), (-1, 0)], [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    inner = on & np.logical_and.reduce([moved(on, *d) for d in sides])
    border = np.pad(on & ~inner, 1)
    code = border + SIDE * sum(moved(border.astype(int), *d) for d in sides) + CORNER * sum(moved(border.astype(int), *d) for d in corners)
    around = sum(BORDER.get(int(c), 0.0) for c in code[border])
    tips = np.unique(np.concatenate([pixels + np.array(d) / 2 for d in sides]), axis=0)
    ring = hull(tips)
    after = np.roll(ring, -1, axis=0) - ring
    turn = np.sign((ring[:, 0] * np.roll(ring[:, 1], -1) - ring[:, 1] * np.roll(ring[:, 0], -1)).sum())
    grid = np.argwhere(np.ones_like(on)) + low
    inside = np.ones(len(grid), bool)
    for corner, step in zip(ring, after):
        inside &= turn * (step[0] * (grid[:, 1] - corner[1]) - step[1] * (grid[:, 0] - corner[0])) >= -1e-9
    return float(len(pixels)), around, len(pixels) / float(inside.sum()), pixels.mean(axis=0)


def structure_features(mask: DataFrame, patches: DataFrame) -> DataFrame:
    """The eleven features of each structure that has a ``mask(sample_id, uid, y, x)`` or ``patches(sample_id, uid, id, row, col, is_peri, value)``.

    Area, circularity and solidity are the mask's; gaps, coverage and the
    three-neighbour graph are those of the patches around it (is_peri), seen from the
    mask's centroid.  A structure is one task: it holds its pixels and patches.
    """
    nil = lambda kind: F.lit(None).cast(kind)
    both = mask.select("sample_id", "uid", nil("long").alias("id"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), nil("double").alias("peri"), nil("double").alias("value")).distinct()
    both = both.unionByName(patches.select("sample_id", "uid", F.col("id").cast("long").alias("id"), F.col("row").cast("double").alias("y"), F.col("col").cast("double").alias("x"), F.col("is_peri").cast("double").alias("peri"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")))

    def build(key: tuple, t: dict[str, np.ndarray]) -> list[tuple]:
        known = np.isnan(t["peri"].astype(float))
        pixels = np.column_stack([t["y"], t["x"]])[known].astype(np.int64)
        area, around, solid, centre = region_shape(pixels) if len(pixels) else (1.0, 0.0, 0.0, np.zeros(2))
        circular = 4 * np.pi * area / (around**2 + 1e-6) if len(pixels) else 0.0
        order = np.argsort(t["id"][~known].astype(np.int64), kind="stable")
        at, peri, value = np.column_stack([t["y"], t["x"]])[~known][order].astype(float), t["peri"][~known][order] > 0, t["value"][~known][order].astype(float)
        n_all, at, value = len(at), at[peri], value[peri]
        n = len(at)
        gap, empty_entropy, parts, largest, degrees, mixing = 1.0, 0.0, 1.0, float(n == 1), 0.0, 0.0
        if n >= 2:
            angle = np.sort(np.arctan2(at[:, 0] - centre[0], at[:, 1] - centre[1]))
            gap = float(np.diff(np.append(angle, angle[0] + 2 * np.pi)).max()) / (2 * np.pi)
            filled = np.count_nonzero(np.histogram(angle, SECTORS, (-np.pi, np.pi))[0]) / SECTORS
            if 0 < filled < 1:
                empty_entropy = float(-(filled * np.log2(filled) + (1 - filled) * np.log2(1 - filled)))
            edges = set()
            for i in range(n):  # a row of distances at a time
                d = ((at - at[i]) ** 2).sum(axis=1)
                d[i] = -1
                edges |= {(min(i, int(j)), max(i, int(j))) for j in np.argsort(d, kind="stable")[1 : NEAR + 1]}
            root = np.arange(n)
            while True:  # the least member of each group spreads along its edges
                ends = np.array(sorted(edges))
                low = root.copy()
                np.minimum.at(low, ends[:, 0], root[ends[:, 1]])
                np.minimum.at(low, ends[:, 1], root[ends[:, 0]])
                if (low == root).all():
                    break
                root = low
            sizes = np.unique(root, return_counts=True)[1]
            parts, largest = len(sizes) / n, float(sizes.max() / n)
            share = np.bincount(ends.reshape(-1), minlength=n) / ends.size
            share = share[share > 0]
            degrees = float(-(share * np.log(share)).sum() / np.log(max(len(share), 2)))
            a, b = value[ends[:, 0]], value[ends[:, 1]]
            mixing = float(np.corrcoef(a, b)[0, 1]) if len(ends) >= 4 and a.std() > 0 and b.std() > 0 else 0.0
        return [(*key, float(np.log1p(area) / np.log1p(1e6)), gap, float(value.mean()) if n else 0.0, n / max(n_all, 1), circular, solid, parts, largest, degrees, mixing, empty_entropy)]

    own = both.withColumns({"sample_id": F.col("sample_id").cast("long"), "id": F.coalesce("id", F.lit(-1))}).where("uid is not null")
    return by_sample(own, ["sample_id", "uid"], build, "sample_id long, uid string, " + ", ".join(f"{c} double" for c in FEATURES_11))


def linked_patches(structure_cells: DataFrame, cross: DataFrame, patches: DataFrame, least: int = 5) -> DataFrame:
    """(uid, patch columns, radius, angle) of patches that a structure's cells touch, by the structure's centre; structures with fewer than ``least`` have none."""
    met = cross.join(structure_cells.select("sample_id", F.col("id").alias("src"), "uid"), ["sample_id", "src"]).select("sample_id", "uid", "dst").distinct()
    centre = structure_cells.groupBy("uid").agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    own = met.join(patches.withColumnRenamed("id", "dst"), ["sample_id", "dst"]).join(centre, "uid")
    n = F.count("*").over(Window.partitionBy("uid"))
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    return own.withColumns({"_n": n, "radius": F.sqrt(dx * dx + dy * dy), "angle": F.atan2(dy, dx)}).where(F.col("_n") >= least).drop("_n", "_cx", "_cy").withColumnRenamed("dst", "id")
