"""Communities of a graph by moving nodes to the neighbouring community of largest gain in modularity, level by level; one sample is one task."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixweave.operators.geometry import by_sample
from matrixweave.plans.scratch import written


def move_nodes(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, resolution: float) -> np.ndarray:
    """Communities of nodes 0 to n - 1; links a, b are undirected, once each, and a loop counts its weight once.

    Links are arrays; a node's neighbours are lists whose numbers are shared, so that a
    link takes some tens of bytes.
    """
    belongs = np.arange(n)
    while True:
        ends, twice = np.column_stack([a, b]).reshape(-1), np.repeat(weight, 2)
        strength = np.bincount(ends, twice, n)
        total = float(strength.sum())
        # Both ways, by node and in the order of links; loops are no neighbours.
        other = np.column_stack([b, a]).reshape(-1)
        ways = np.argsort(ends, kind="stable")
        ways = ways[ends[ways] != other[ways]]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(ends[ways], minlength=n)))).tolist()
        numbers = list(range(n))
        near, far = list(map(numbers.__getitem__, other[ways].tolist())), twice[ways].tolist()
        del ends, twice, other, ways
        own, held, each = numbers.copy(), strength.tolist(), strength.tolist()
        moved_any = False
        for _ in range(100):
            moved = False
            for v in range(n):
                i, j = bounds[v], bounds[v + 1]
                if i == j:
                    continue
                to: dict[int, float] = {}
                for u, w in zip(near[i:j], far[i:j]):
                    c = own[u]
                    to[c] = to.get(c, 0.0) + w
                here, mine = own[v], each[v]
                held[here] -= mine
                best, value = here, to.get(here, 0.0) - resolution * mine * held[here] / total if total else 0.0
                for c in sorted(to):
                    gain = to[c] - resolution * mine * held[c] / total if total else 0.0
                    if gain > value + 1e-12:
                        best, value = c, gain
                held[best] += mine
                if best != here:
                    own[v], moved = best, True
            moved_any |= moved
            if not moved:
                break
        del near, far
        names, to_name = np.unique(np.array(own), return_inverse=True)
        belongs = to_name[belongs]
        if not moved_any or len(names) == n:
            return belongs
        n = len(names)
        a, b, weight = merged(to_name[a], to_name[b], weight, n)


def merged(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each undirected link once with its summed weight, in the order in which links are first met."""
    key, first, of = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_index=True, return_inverse=True)
    order = np.argsort(first)
    key, weight = key[order], np.bincount(of, weight, len(key))[order]
    return key // n, key % n, weight


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(sample_id, id, community) of nodes with edges, 0 for the largest community; ties go by smallest id."""

    def build(key: tuple, t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        ids, ends = np.unique(np.concatenate([t["src"], t["dst"]]), return_inverse=True)
        a, b = ends.reshape(2, -1)
        order = np.lexsort((t["weight"], b, a))
        found = move_nodes(len(ids), *merged(a[order], b[order], t["weight"][order], len(ids)), resolution)
        _, first, size = np.unique(found, return_index=True, return_counts=True)
        rank = np.empty(len(first), np.int32)
        rank[np.lexsort((first, -size))] = np.arange(len(first))
        return {"sample_id": np.full(len(ids), key[0]), "id": ids, "community": rank[found]}

    own = edges.select(F.col("sample_id").cast("long").alias("sample_id"), "src", "dst", (F.col("weight") if "weight" in edges.columns else F.lit(1.0)).cast("double").alias("weight"))
    return by_sample(own, ["sample_id"], build, "sample_id long, id long, community int")


def select_resolution(edges: DataFrame, spread: DataFrame, resolutions: list[float]) -> DataFrame:
    """(sample_id, resolution, n, calinski_harabasz, best) of the communities of ``edges`` at each resolution.

    ``spread(sample_id, id, z)`` has the features, as vectors.  The index is that of the nodes
    with edges, null where there are fewer than two communities or none has two nodes; the best
    resolution has the largest index, ties the lowest, and without any index the lowest is best.
    """
    from pyspark.ml.functions import vector_to_array

    own = spread.select(F.col("sample_id").cast("long").alias("sample_id"), "id", F.posexplode(vector_to_array("z")).alias("k", "v"))
    edges = written(edges, "resolution-edges")
    found = [communities(edges, r).withColumn("resolution", F.lit(float(r))) for r in resolutions]
    long = functools.reduce(DataFrame.unionByName, found).join(own.hint("merge"), ["sample_id", "id"])
    by = ["sample_id", "resolution"]
    sums = long.groupBy(*by, "community", "k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") ** 2).alias("q"))
    all_ = Window.partitionBy(*by, "k")
    parts = sums.withColumn("_m", F.sum("s").over(all_) / F.sum("n").over(all_))
    out = parts.groupBy(*by).agg(
        F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("_m")) ** 2).alias("_b"), F.sum(F.col("q") - F.col("s") ** 2 / F.col("n")).alias("_w"), F.countDistinct("community").alias("n"), (F.sum("n") / F.countDistinct("k")).alias("_n")
    )
    index = F.when((F.col("n") > 1) & (F.col("_n") > F.col("n")) & (F.col("_w") > 0), F.col("_b") / (F.col("n") - 1) / (F.col("_w") / (F.col("_n") - F.col("n"))))
    out = out.select(*by, "n", index.alias("calinski_harabasz"))
    order = Window.partitionBy("sample_id").orderBy(F.desc_nulls_last(F.round("calinski_harabasz", 9)), "resolution")
    return out.withColumn("best", F.row_number().over(order) == 1)
