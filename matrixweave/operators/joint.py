"""One graph of cells and patches: edges within each kind and across, by a method of choice, under one set of types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixweave.operators import geometry, spatial

CELL, PATCH = "cell", "ecm"


def edges_within(points: DataFrame, method: str, k: int = 5, radius: float = 20.0, cap: float | None = None) -> DataFrame:
    """(sample_id, src, dst, d), src < dst, of ``points(sample_id, id, x, y)``.

    Methods are knn, radius, delaunay, and grid4 and grid8 for points with grid_y and grid_x.
    """
    if method == "knn":
        out = spatial.knn_edges(points, k, cap)
    elif method == "radius":
        out = spatial.radius_edges(points, radius)
    elif method == "delaunay":
        out = geometry.delaunay_edges(points, cap)
    elif method in ("grid4", "grid8"):
        pairs = spatial.grid_edges(points.withColumnRenamed("id", "patch_id"), int(method[-1]))
        out = spatial.adopt_adjacency(pairs, points)
    else:
        raise ValueError(f"methods are knn, radius, delaunay, grid4 and grid8, not {method!r}")
    return out.select("sample_id", "src", "dst", "d")


def edges_across(cells: DataFrame, patches: DataFrame, method: str, k: int = 5, radius: float = 20.0, cap: float | None = None) -> DataFrame:
    """(sample_id, src cell, dst patch, d); methods are knn (of each cell), radius and delaunay (of both kinds together)."""
    if method == "knn":
        out = spatial.nearest(cells, patches, k, cap=cap)
    elif method == "radius":
        out = spatial.range_join(cells, patches, radius)
    elif method == "delaunay":
        out = geometry.delaunay_bipartite(cells, patches, cap)
    else:
        raise ValueError(f"methods are knn, radius and delaunay, not {method!r}")
    return out.select("sample_id", "src", "dst", "d")


def joint_graph(cells: DataFrame, patches: DataFrame, cell: str = "knn", patch: str = "grid8", cross: str = "radius", k: int = 5, radius: float = 20.0, cap: float | None = None, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``cells`` and ``patches(sample_id, id, x, y, label, …)``; a node is known by sample_id, node_type and id.

    nodes: (sample_id, node_type, id, x, y, label as string); edges: (sample_id,
    src_type, src, dst_type, dst, d, weight), each undirected edge once, weight 1 / d, or
    0 at d = 0.  ``scale`` turns positions into the unit of ``radius`` and ``cap``, and of
    the distances given.  Null positions take no part in edges.
    """
    parts = {}
    for name, df in ((CELL, cells), (PATCH, patches)):
        parts[name] = df.withColumns({"x": F.col("x") * scale, "y": F.col("y") * scale})
    nodes = [df.select("sample_id", F.lit(name).alias("node_type"), "id", "x", "y", F.col("label").cast("string").alias("label")) for name, df in parts.items()]
    at = {name: df.where("x is not null and y is not null") for name, df in parts.items()}
    edges = [
        (CELL, CELL, edges_within(at[CELL], cell, k, radius, cap)),
        (PATCH, PATCH, edges_within(at[PATCH], patch, k, radius, cap)),
        (CELL, PATCH, edges_across(at[CELL], at[PATCH], cross, k, radius, cap)),
    ]
    weight = F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(0.0)
    out = [e.select(F.col("sample_id").cast("long").alias("sample_id"), F.lit(a).alias("src_type"), "src", F.lit(b).alias("dst_type"), "dst", "d", weight.alias("weight")) for a, b, e in edges]
    return nodes[0].unionByName(nodes[1]), out[0].unionByName(out[1]).unionByName(out[2])
