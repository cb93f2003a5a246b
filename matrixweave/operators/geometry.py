"""Triangulations: one sample is one task, since a triangulation is not a join.

``triangulate`` inserts points one at a time: the triangles whose circumcircle holds the
new point go, and their outline is joined to it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixweave.operators.spatial import knn_edges, nearest
from matrixweave.plans.scratch import written


def triangulate(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles (m x 3 rows of ``points``); none of fewer than three or of collinear points.

    Points that coincide with an earlier one are left out.
    """
    _, first = np.unique(points, axis=0, return_index=True)
    order = np.sort(first)
    p = points[order].astype(float)
    if len(p) < 3:
        return np.zeros((0, 3), np.int64)
    centre, size = p.mean(axis=0), float(np.ptp(p, axis=0).max()) or 1.0
    p = (p - centre) / size
    n = len(p)
    far = 1e4
    q = np.vstack([p, [[-far, -far], [far, -far], [0, far]]])
    triangles = np.array([[n, n + 1, n + 2]])
    circles = _circles(q, triangles)
    for i in range(n):
        inside = ((q[i] - circles[:, :2]) ** 2).sum(axis=1) < circles[:, 2] * (1 + 1e-12)
        bad = triangles[inside]
        edges = np.sort(np.vstack([bad[:, [0, 1]], bad[:, [1, 2]], bad[:, [2, 0]]]), axis=1)
        outline, count = np.unique(edges, axis=0, return_counts=True)
        outline = outline[count == 1]
        new = np.column_stack([outline, np.full(len(outline), i)])
        made = _circles(q, new)
        fine = np.isfinite(made[:, 2])
        triangles = np.vstack([triangles[~inside], new[fine]])
        circles = np.vstack([circles[~inside], made[fine]])
    real = triangles[(triangles < n).all(axis=1)]
    return order[real]


def _circles(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Circumcentre and squared radius of triangles; infinite for collinear ones."""
    a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
    bx, by = (b - a).T
    cx, cy = (c - a).T
    d = 2 * (bx * cy - by * cx)
    with np.errstate(divide="ignore", invalid="ignore"):
        ux = (cy * (bx**2 + by**2) - by * (cx**2 + cy**2)) / d
        uy = (bx * (cx**2 + cy**2) - cx * (bx**2 + by**2)) / d
    r2 = np.where(np.abs(d) > 1e-14, ux**2 + uy**2, np.inf)
    return np.column_stack([a[:, 0] + ux, a[:, 1] + uy, r2])


def triangle_edges(triangles: np.ndarray) -> np.ndarray:
    edges = np.vstack([triangles[:, [0, 1]], triangles[:, [1, 2]], triangles[:, [2, 0]]]) if len(triangles) else np.zeros((0, 2), np.int64)
    return np.unique(np.sort(edges, axis=1), axis=0)


def void_area(points: np.ndarray, alpha2: float) -> float:
    """The largest hole of the points' alpha shape: triangles of squared circumradius over ``alpha2`` joined by edges that are not in the shape.

    An edge is in the shape if a triangle of it is, or if it is short enough and no
    point lies in the circle around it.  What an open edge joins to the outside is no hole.
    """
    triangles = triangulate(points)
    if len(points) < 4 or not len(triangles):
        return 0.0
    filled = _circles(points.astype(float), triangles)[:, 2] <= alpha2
    sides: dict[tuple[int, int], list[int]] = {}
    for k, t in enumerate(triangles.tolist()):
        for a, b in ((0, 1), (1, 2), (2, 0)):
            sides.setdefault(tuple(sorted((t[a], t[b]))), []).append(k)
    parent = list(range(len(triangles) + 1))  # the last is the outside

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (a, b), own in sides.items():
        if any(filled[k] for k in own):
            continue
        half = points[a] / 2 + points[b] / 2
        r2 = ((points[a] - points[b]) ** 2).sum() / 4
        apex = [points[v] for k in own for v in triangles[k] if v not in (a, b)]
        if r2 <= alpha2 and all(((v - half) ** 2).sum() >= r2 for v in apex):
            continue
        other = own[1] if len(own) > 1 else len(triangles)
        parent[find(own[0])] = find(other)
    a, b, c = (points[triangles[:, k]].astype(float) for k in range(3))
    area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
    total: dict[int, float] = {}
    for k in np.flatnonzero(~filled):
        total[find(int(k))] = total.get(find(int(k)), 0.0) + float(area[k])
    total.pop(find(len(triangles)), None)
    return max(total.values(), default=0.0)


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull's corners, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def by_sample(df: DataFrame, keys: list[str], build: Callable[[tuple, dict[str, np.ndarray]], list[tuple] | dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Rows, or columns, that ``build(key, columns)`` makes of each group."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        columns = {c: np.asarray(table.column(c)) for c in table.column_names}
        rows = build(tuple(k.as_py() for k in key), columns)
        if isinstance(rows, dict):
            return pa.Table.from_pydict(rows, schema=_arrow(schema))
        return pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=_arrow(schema))

    return df.groupBy(*keys).applyInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (part.split() for part in schema.split(","))])


def delaunay_edges(points: DataFrame, cap: float | None = None) -> DataFrame:
    """(sample_id, src, dst, d) of triangulated points; samples of fewer than three points are joined to their nearest."""

    def build(key: tuple, t: dict[str, np.ndarray]) -> list[tuple]:
        order = np.argsort(t["id"], kind="stable")
        ids, xy = t["id"][order], np.column_stack([t["x"], t["y"]])[order]
        edges = triangle_edges(triangulate(xy))
        return [(key[0], *sorted((int(ids[a]), int(ids[b]))), float(np.sqrt(((xy[a] - xy[b]) ** 2).sum()))) for a, b in edges]

    own = points.select(F.col("sample_id").cast("long").alias("sample_id"), "id", "x", "y")
    found = by_sample(own, ["sample_id"], build, "sample_id long, src long, dst long, d double")
    small = own.join(own.groupBy("sample_id").count().where("count < 3").select("sample_id"), "sample_id", "left_semi")
    if not small.isEmpty():
        found = found.unionByName(knn_edges(small, 2))
    return found.where(F.col("d") <= cap) if cap is not None else found


def delaunay_bipartite(a: DataFrame, b: DataFrame, cap: float | None = None) -> DataFrame:
    """(sample_id, src of a, dst of b, d): edges between the two kinds in the triangulation of both; samples of fewer than three points: the nearest."""

    def build(key: tuple, t: dict[str, np.ndarray]) -> list[tuple]:
        order = np.lexsort((t["id"], t["kind"]))
        ids, kind, xy = t["id"][order], t["kind"][order], np.column_stack([t["x"], t["y"]])[order]
        edges = triangle_edges(triangulate(xy))
        cross = [(i, j) if kind[i] < kind[j] else (j, i) for i, j in edges if kind[i] != kind[j]]
        return [(key[0], int(ids[i]), int(ids[j]), float(np.sqrt(((xy[i] - xy[j]) ** 2).sum()))) for i, j in cross]

    parts = [df.select(F.col("sample_id").cast("long").alias("sample_id"), "id", "x", "y", F.lit(k).alias("kind")) for k, df in enumerate((a, b))]
    both = parts[0].unionByName(parts[1])
    found = by_sample(both, ["sample_id"], build, "sample_id long, src long, dst long, d double")
    few = both.groupBy("sample_id").count().where("count < 3").select("sample_id")
    if not few.isEmpty():
        found = found.unionByName(nearest(parts[0].join(few, "sample_id", "left_semi"), parts[1], 1).select("sample_id", "src", "dst", "d"))
    return found.where(F.col("d") <= cap) if cap is not None else found


def central_voids(points: DataFrame, radius: float, by: str = "component") -> DataFrame:
    """(sample_id, by, void): the largest hole inside each component's alpha shape at half ``radius``."""

    def build(key: tuple, t: dict[str, np.ndarray]) -> list[tuple]:
        return [(*key, void_area(np.column_stack([t["x"], t["y"]]).astype(float), (radius / 2) ** 2))]

    own = points.select(F.col("sample_id").cast("long").alias("sample_id"), F.col(by).cast("long").alias(by), "x", "y")
    return by_sample(own, ["sample_id", by], build, f"sample_id long, {by} long, void double")


def path_measures(components: DataFrame, edges: DataFrame, most: int = 5000, sources: int = 2048) -> DataFrame:
    """(sample_id, component, n_nodes, diameter, mean_path, betweenness, closeness, fiedler) of connected components.

    Null for components of three nodes or fewer; the Laplacian's second eigenvalue is
    also null beyond ``most`` nodes.
    """
    return path_lengths(components, edges, sources).join(fiedler_values(components, edges, most), ["sample_id", "component"], "left")


def _of_components(components: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges with their component, and the number of nodes with edges of each component."""
    member = components.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("id").alias("src"), F.col("component").cast("long").alias("component"))
    own = written(edges.select(F.col("sample_id").cast("long").alias("sample_id"), "src", "dst").join(member, ["sample_id", "src"]), "component-edges")
    sizes = own.select("sample_id", "component", F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy("sample_id", "component").agg(F.count("*").cast("int").alias("n_nodes"))
    return own, written(sizes, "component-sizes")


def _neighbours(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and each node's neighbours, once each and without itself, as offsets and numbers."""
    ids, flat = np.unique(np.concatenate([t["src"], t["dst"]]), return_inverse=True)
    a, b = flat.reshape(2, -1)
    a, b = a[a != b], b[a != b]
    pairs = np.unique(np.concatenate([a * len(ids) + b, b * len(ids) + a]))
    return ids, np.searchsorted(pairs, np.arange(len(ids) + 1) * len(ids)), pairs % max(len(ids), 1)


#: Sources of one search, 64 a word, and words that are gathered at a time.
_SEARCH, _GATHER = 512, 1 << 22


def distance_sums(offsets: np.ndarray, near: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node's sum of the distances to nodes ``first`` to ``last`` - 1 that it reaches, and the largest of them.

    The sources are bits, which go from nodes to their neighbours all at once, a distance a round.
    """
    n = len(offsets) - 1
    sums, longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
    linked = np.flatnonzero(np.diff(offsets))
    for start in range(first, last, _SEARCH):
        s = np.arange(start, min(start + _SEARCH, last))
        words = -(-len(s) // 64)
        seen = np.zeros((n, words), np.uint64)
        seen[s, (s - start) // 64] = np.uint64(1) << ((s - start) % 64).astype(np.uint64)
        front, depth = seen.copy(), 0
        while True:
            depth += 1
            new = np.zeros_like(seen)
            at = 0
            while at < len(linked):
                # As many nodes as have _GATHER words of neighbours, one at least.
                to = max(at + 1, int(np.searchsorted(offsets[linked], offsets[linked[at]] + _GATHER // words, side="right")) - 1)
                part = linked[at:to]
                here = front[near[offsets[part[0]] : offsets[part[-1] + 1]]]
                new[part] = np.bitwise_or.reduceat(here, offsets[part] - offsets[part[0]], axis=0)
                at = to
            new &= ~seen
            count = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
            if not count.any():
                break
            sums += depth * count
            longest[count > 0] = np.maximum(longest[count > 0], depth)
            seen |= new
            front = new
    return sums, longest


def path_lengths(components: DataFrame, edges: DataFrame, sources: int = 2048) -> DataFrame:
    """``path_measures`` without the eigenvalue, from the distances of all pairs of nodes.

    A task searches from ``sources`` nodes of a component, whose edges it holds.  The mean
    betweenness follows from the distances, as a shortest path of d edges has d - 1 inner nodes.
    """
    own, sizes = _of_components(components, edges)
    dealt = own.join(sizes, ["sample_id", "component"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"(n_nodes - 1) div {sources}").cast("int"))))

    def build(key: tuple, t: dict[str, np.ndarray]) -> list[tuple]:
        ids, offsets, near = _neighbours(t)
        sums, longest = distance_sums(offsets, near, key[2] * sources, min((key[2] + 1) * sources, len(ids)))
        return list(zip([key[0]] * len(ids), [key[1]] * len(ids), ids.tolist(), sums.tolist(), longest.tolist()))

    big = dealt.where("n_nodes > 3").select("sample_id", "component", "block", "src", "dst")
    found = by_sample(big, ["sample_id", "component", "block"], build, "sample_id long, component long, id long, total long, longest long")
    by_node = found.groupBy("sample_id", "component", "id").agg(F.sum("total").alias("total"), F.max("longest").alias("longest"))
    n = F.col("n_nodes").cast("double")
    out = sizes.join(by_node, ["sample_id", "component"], "left").groupBy("sample_id", "component", "n_nodes")
    out = out.agg(F.max("longest").cast("int").alias("diameter"), F.sum("total").alias("_all"), F.avg((n - 1) / F.col("total")).alias("closeness"))
    return out.select("sample_id", "component", "n_nodes", "diameter", (F.col("_all") / (n * (n - 1))).alias("mean_path"), ((F.col("_all") - n * (n - 1)) / (n * (n - 1) * (n - 2))).alias("betweenness"), "closeness")


def fiedler_values(components: DataFrame, edges: DataFrame, most: int = 5000) -> DataFrame:
    """(sample_id, component, fiedler): the Laplacian's second eigenvalue of components of four to ``most`` nodes, each in one task."""
    own, sizes = _of_components(components, edges)
    own = own.join(sizes.where(f"n_nodes between 4 and {most}").drop("n_nodes"), ["sample_id", "component"], "left_semi")

    def build(key: tuple, t: dict[str, np.ndarray]) -> list[tuple]:
        ids, offsets, near = _neighbours(t)
        laplacian = np.diag(np.diff(offsets).astype(float))
        laplacian[np.repeat(np.arange(len(ids)), np.diff(offsets)), near] = -1
        return [(*key, float(np.linalg.eigvalsh(laplacian)[1]))]

    return by_sample(own, ["sample_id", "component"], build, "sample_id long, component long, fiedler double")
