"""Approximate nearest neighbours by inner product: a vantage-point tree per shard, under one that deals the shards.

The largest inner product is the smallest distance once every vector has one more
component, sqrt(R^2 - |x|^2) with R the largest norm, and the query has zero there.  At
a node, the vectors are split at the median distance from a vantage point; a child whose
distances lie in [low, high] is skipped by a query at distance d if d + factor * tau < low
or d - factor * tau > high, with tau the distance of its k-th best so far.  By the
triangle inequality factor one skips nothing that counts: the search is then exact.
Smaller factors skip more.

The top tree is grown on the driver from a sample of ``SAMPLE_ROWS`` rows a leaf, with a
leaf for about ``shard_rows`` rows and ``MOST_LEAVES`` at most; every row is dealt to a
leaf by it, and the distances of all rows give its bounds.  A leaf of more rows than
``shard_rows``, such as that of a vector which very many rows hold, is cut into several
shards.  Each shard's tree is built in one task.

A query is searched in the shards of its own leaf first.  Its k-th best there prunes the
other leaves, and it goes to the shards of those that are left.  Queries come in blocks
of about ``BLOCK_ROWS``; each (shard, block) is a task that takes all its queries down the
tree together, and the k best of each meet in a ranking by query.  Scores are summed
component by component in double precision from the original vectors, so equal vectors
tie exactly; ties go to the smaller vec_id.

Null vectors, and those that hold null or non-finite components, are empty or all zero,
take no part; vectors meet only those of their own length.  Rows with the query's
vec_id are its own.  Repeated rows count as often as they come, and each query row has
a result of its own, also where rows share a vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrixweave.llm.common import stash

K, FACTOR = 20, 1.0
SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 8192, 64
#: Sampled rows a leaf of the top tree, and its leaves at most.
SAMPLE_ROWS, MOST_LEAVES = 64, 256
#: How far a fast score may lie from the exact one.
SLACK = 1e-9
#: How far the square of a distance may, as a share of the squares it is made of: near zero its root is off by far more.
SQUARE_SLACK = 1e-12


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class Tree:
    """Vectors in leaf order; node i: vantage point, children (or -1 and a range of rows), and each child's distances."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        norms = (vectors * vectors).sum(axis=1)
        self.radius2 = float(norms.max())
        lifted = np.hstack([vectors, np.sqrt(np.maximum(self.radius2 - norms, 0))[:, None]])
        self.points: list[np.ndarray] = []
        self.kids: list[tuple[int, int]] = []
        self.spans: list[tuple[int, int]] = []
        self.bounds: list[tuple[float, float, float, float]] = []
        rows: list[np.ndarray] = []
        at = 0

        def grow(own: np.ndarray) -> int:
            nonlocal at
            me = len(self.kids)
            self.kids.append((-1, -1))
            self.points.append(lifted[own[0]])
            self.spans.append((at, at + len(own)))
            self.bounds.append((0.0, 0.0, 0.0, 0.0))
            if len(own) <= leaf:
                rows.append(own)
                at += len(own)
                return me
            # The vantage point is the row farthest from the first one: ends see the spread best.
            far = own[int(((lifted[own] - lifted[own[0]]) ** 2).sum(axis=1).argmax())]
            distance = np.sqrt(((lifted[own] - lifted[far]) ** 2).sum(axis=1))
            ranked = np.argsort(distance, kind="stable")
            half = len(own) // 2
            inner, outer = ranked[:half], ranked[half:]
            self.points[me] = lifted[far]
            self.bounds[me] = (float(distance[inner[0]]), float(distance[inner[-1]]), float(distance[outer[0]]), float(distance[outer[-1]]))
            a = grow(np.sort(own[inner]))
            b = grow(np.sort(own[outer]))
            self.kids[me] = (a, b)
            return me

        grow(np.arange(len(ids)))
        order = np.concatenate(rows)
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.seen = 0

    def pack(self) -> dict[str, bytes]:
        arrays = {"ids": self.ids, "vectors": self.vectors, "points": np.array(self.points), "kids": np.array(self.kids), "spans": np.array(self.spans), "bounds": np.array(self.bounds)}
        return {k: np.ascontiguousarray(v, np.int64 if k in ("ids", "kids", "spans") else np.float64).tobytes() for k, v in arrays.items()} | {"radius2": self.radius2}

    @classmethod
    def unpack(cls, row: dict, dim: int) -> Tree:
        own = cls.__new__(cls)
        read = lambda k, kind, wide: np.frombuffer(row[k], kind).reshape(-1, wide)
        own.ids, own.vectors, own.points = np.frombuffer(row["ids"], np.int64), read("vectors", np.float64, dim), read("points", np.float64, dim + 1)
        own.kids, own.spans, own.bounds = read("kids", np.int64, 2).tolist(), read("spans", np.int64, 2).tolist(), read("bounds", np.float64, 4).tolist()
        own.radius2, own.seen = row["radius2"], 0
        return own

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float, floor: np.ndarray | float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, vec_id, score) of the k best rows found for each query; rows under its ``floor`` need not be found."""
        floor = np.broadcast_to(floor, len(ids))
        size = (queries * queries).sum(axis=1) + self.radius2
        lifted = np.hstack([queries, np.zeros((len(queries), 1))])
        score = np.full((len(queries), k), -np.inf)
        best = np.full((len(queries), k), np.iinfo(np.int64).max)

        def leaf(a: int, b: int, own: np.ndarray) -> None:
            self.seen += len(own) * (b - a)
            fast = queries[own] @ self.vectors[a:b].T
            fast[self.ids[a:b] == ids[own][:, None]] = -np.inf  # rows of the query's own vec_id, which may repeat
            least = np.maximum(score[own, -1], floor[own])
            if b - a > k:
                # A row under the k best others of this leaf can't count.
                least = np.maximum(least, -np.partition(-fast, k - 1, axis=1)[:, k - 1])
            with np.errstate(invalid="ignore"):
                q, c = np.nonzero(fast >= (least - SLACK * size[own])[:, None])
            other = self.ids[a + c] != ids[own[q]]
            q, c = own[q[other]], a + c[other]
            for s in range(0, len(q), 1 << 16):
                merge(q[s : s + (1 << 16)], c[s : s + (1 << 16)])

        def merge(q: np.ndarray, c: np.ndarray) -> None:
            exact = np.cumsum(queries[q] * self.vectors[c], axis=1)[:, -1]
            own = np.unique(q)
            rows = np.concatenate((np.repeat(own, k), q))
            scores = np.concatenate((score[own].reshape(-1), exact))
            found = np.concatenate((best[own].reshape(-1), self.ids[c]))
            order = np.lexsort((found, -scores, rows))
            rows, scores, found = rows[order], scores[order], found[order]
            starts = np.searchsorted(rows, own)
            rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
            keep = rank < k
            score[rows[keep], rank[keep]] = scores[keep]
            best[rows[keep], rank[keep]] = found[keep]

        def visit(node: int, own: np.ndarray) -> None:
            if not len(own):
                return
            a, b = self.kids[node]
            if a < 0:
                return leaf(*self.spans[node], own)
            point = self.points[node]
            square, off = size[own] - 2 * (lifted[own] @ point) + (point @ point - self.radius2), SQUARE_SLACK * size[own]
            least, most = np.sqrt(np.maximum(square - off, 0)), np.sqrt(np.maximum(square + off, 0))
            low1, high1, low2, high2 = self.bounds[node]
            inside = least <= (high1 + low2) / 2

            def open_to(mask: np.ndarray, low: float, high: float) -> np.ndarray:
                with np.errstate(invalid="ignore"):
                    tau = np.sqrt(np.maximum(size[own] - 2 * np.maximum(score[own, -1], floor[own]), 0) + off) * factor + SLACK
                return own[mask & (most + tau >= low) & (least - tau <= high)]

            visit(a, own[inside])
            visit(b, own[~inside])
            visit(b, open_to(inside, low2, high2))
            visit(a, open_to(~inside, low1, high1))

        visit(0, np.arange(len(queries)))
        q, c = np.nonzero(np.isfinite(score))
        return q, best[q, c], score[q, c]


class Top:
    """The top tree of vectors of one length: node i has a vantage point, the distance that parts its children, and their numbers; or a leaf's number."""

    def __init__(self, sample: np.ndarray, radius2: float, leaves: int):
        self.radius2 = radius2
        self.points: list[np.ndarray] = []
        self.parts: list[float] = []
        self.kids: list[tuple[int, int]] = []
        self.leaf: list[int] = []
        self.bounds: dict[tuple[int, int], tuple[float, float]] = {}
        self.leaves = 0
        lifted = np.hstack([sample, np.sqrt(np.maximum(radius2 - (sample * sample).sum(axis=1), 0))[:, None]])

        def grow(own: np.ndarray, wanted: int) -> int:
            me = len(self.kids)
            self.kids.append((-1, -1))
            self.points.append(np.zeros(0))
            self.parts.append(0.0)
            self.leaf.append(-1)
            if wanted > 1 and len(own) > 1:
                far = lifted[own[int(((lifted[own] - lifted[own[0]]) ** 2).sum(axis=1).argmax())]]
                distance = np.sqrt(((lifted[own] - far) ** 2).sum(axis=1))
                part = float(np.quantile(distance, (wanted // 2) / wanted))
                inner, outer = own[distance <= part], own[distance > part]
                if len(inner) and len(outer):
                    self.points[me], self.parts[me] = far, part
                    self.kids[me] = grow(inner, wanted // 2), grow(outer, wanted - wanted // 2)
                    return me
            self.leaf[me] = self.leaves
            self.leaves += 1
            return me

        grow(np.arange(len(sample)), leaves)

    def _distance(self, node: int, vectors: np.ndarray, last: np.ndarray) -> np.ndarray:
        point = self.points[node]
        return np.sqrt(((vectors - point[:-1]) ** 2).sum(axis=1) + (last - point[-1]) ** 2)

    def route(self, vectors: np.ndarray, queries: bool = False) -> tuple[np.ndarray, list[list[float]]]:
        """(leaf, distances from the vantage points above it) of each vector."""
        last = np.zeros(len(vectors)) if queries else np.sqrt(np.maximum(self.radius2 - (vectors * vectors).sum(axis=1), 0))
        leaf, path = np.zeros(len(vectors), np.int32), [[] for _ in range(len(vectors))]

        def down(node: int, own: np.ndarray) -> None:
            if not len(own):
                return
            if self.leaf[node] >= 0:
                leaf[own] = self.leaf[node]
                return
            distance = self._distance(node, vectors[own], last[own])
            for i, d in zip(own.tolist(), distance.tolist()):
                path[i].append(d)
            inside = distance <= self.parts[node]
            for kid, mask in zip(self.kids[node], (inside, ~inside)):
                down(kid, own[mask])

        down(0, np.arange(len(vectors)))
        return leaf, path

    def bound(self, seen: dict[int, tuple[list[float], list[float]]]) -> None:
        """Take the least and largest distances of the leaves' rows, by depth; a leaf without rows is never opened."""

        def up(node: int, depth: int) -> tuple[list[float], list[float]]:
            none = [np.inf] * 64, [-np.inf] * 64
            if self.leaf[node] >= 0:
                low, high = seen.get(self.leaf[node], ([], []))
                return low + none[0][len(low) :], high + none[1][len(high) :]
            both = [up(kid, depth + 1) for kid in self.kids[node]]
            for side, (low, high) in enumerate(both):
                self.bounds[node, side] = low[depth], high[depth]
            return [min(x) for x in zip(both[0][0], both[1][0])], [max(x) for x in zip(both[0][1], both[1][1])]

        up(0, 0)

    def open(self, queries: np.ndarray, floor: np.ndarray, factor: float) -> list[list[int]]:
        """The leaves that may hold a row at or over each query's ``floor``."""
        size = (queries * queries).sum(axis=1) + self.radius2
        with np.errstate(invalid="ignore"):
            tau = np.sqrt(np.maximum(size - 2 * floor, 0) + SQUARE_SLACK * size) * factor + SLACK * (1 + size)
        last, out = np.zeros(len(queries)), [[] for _ in range(len(queries))]

        def down(node: int, own: np.ndarray) -> None:
            if not len(own):
                return
            if self.leaf[node] >= 0:
                for i in own.tolist():
                    out[i].append(self.leaf[node])
                return
            distance = self._distance(node, queries[own], last[own])
            for side, kid in enumerate(self.kids[node]):
                low, high = self.bounds[node, side]
                down(kid, own[(distance + tau[own] >= low) & (distance - tau[own] <= high)])

        down(0, np.arange(len(queries)))
        return out


TREE = "dim int, leaf int, shard int, ids binary, vectors binary, points binary, kids binary, spans binary, bounds binary, radius2 double"


def _matrix(table: pa.Table | pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    rows = table.column(column)
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    return np.asarray(rows.flatten()).astype(np.float64).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(dims == dim)))


def top_trees(rows: DataFrame, shard_rows: int) -> dict[int, Top]:
    """The top tree of each length of ``rows(vector, dim)``; only the samples reach the driver."""
    out = {}
    for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("radius2")).collect():
        leaves = min(MOST_LEAVES, math.ceil(r.n / shard_rows))
        some = np.zeros((0, r.dim))
        if leaves > 1:
            own = rows.where(F.col("dim") == r.dim).select("vector")
            own = own.sample(min(1.0, 2 * SAMPLE_ROWS * leaves / r.n), seed=1).limit(SAMPLE_ROWS * leaves).toArrow()
            some = _matrix(own, "vector", r.dim) if own.num_rows else some
        out[r.dim] = Top(some, r.radius2, leaves)
    return out


def build_trees(routed: DataFrame, shards: DataFrame) -> DataFrame:
    """One row a shard of ``routed(vec_id, vector, dim, leaf)``: its packed tree; ``shards(dim, leaf, shards)``."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        dim, leaf, shard = (k.as_py() for k in key)
        packed = Tree(np.asarray(table.column("vec_id")), _matrix(table, "vector", dim)).pack()
        return pa.Table.from_pylist([{"dim": dim, "leaf": leaf, "shard": shard} | packed], schema=pa.schema([("dim", pa.int32()), ("leaf", pa.int32()), ("shard", pa.int32()), *((k, pa.binary()) for k in ("ids", "vectors", "points", "kids", "spans", "bounds")), ("radius2", pa.float64())]))

    dealt = routed.join(F.broadcast(shards), ["dim", "leaf"]).withColumn("shard", (F.monotonically_increasing_id() % F.col("shards")).cast("int"))
    return dealt.select("vec_id", "vector", "dim", "leaf", "shard").groupBy("dim", "leaf", "shard").applyInArrow(build, TREE)


def _search(asked: DataFrame, trees: DataFrame, shards: DataFrame, k: int, factor: float) -> DataFrame:
    """(key, query_id, vec_id, score): the k best of each (shard, query) of ``asked(key, query_id, vector, dim, leaf, floor)``, written."""
    asked = asked.where("leaf is not null")
    blocks = asked.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    plan = stash(shards.join(blocks, ["dim", "leaf"]), "ann-plan")  # a row a leaf
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(F.broadcast(plan), ["dim", "leaf"]).withColumn("block", F.expr("cast(pmod(key, blocks) as int)")).withColumn("shard", each("shards")).drop("blocks", "shards")
    own = trees.join(F.broadcast(plan.select("dim", "leaf", "blocks")), ["dim", "leaf"]).withColumn("block", each("blocks")).drop("blocks")
    by = ("dim", "leaf", "shard", "block")

    def search(group: tuple, tree: pa.Table, block: pa.Table) -> pa.Table:
        names = ["key", "query_id", "vec_id", "score"]
        if not tree.num_rows or not block.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names)
        dim = group[0].as_py()
        ids, floor = np.asarray(block.column("query_id")), np.asarray(block.column("floor"))
        q, found, score = Tree.unpack(tree.to_pylist()[0], dim).search(ids, _matrix(block, "vector", dim), k, factor, floor)
        return pa.table([block.column("key").combine_chunks().take(pa.array(q)), pa.array(ids[q]), pa.array(found), pa.array(score)], names)

    near = own.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, "key long, query_id long, vec_id long, score double")
    return stash(_best(near, k), "ann-near")


def _best(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key", "query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, seen: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of ``vectors`` found nearest to each row of ``queries``.

    ``seen``, if given, gets the number of (query, leaf) pairs that were ``searched``, and of all that there ``are``.
    """
    clean = lambda df: df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.size(vector_col).alias("dim"))
    spark, rows = vectors.sparkSession, clean(vectors)
    tops = top_trees(rows, shard_rows)
    shared = spark.sparkContext.broadcast(tops)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                leaf, path = shared.value[dim].route(_matrix(part, "vector", dim))
                yield pa.record_batch([*part.columns, pa.array(leaf), pa.array(path, pa.list_(pa.float64()))], [*part.schema.names, "leaf", "path"])

    routed = stash(rows.mapInArrow(route, "vec_id long, vector array<double>, dim int, leaf int, path array<double>"), "ann-rows")
    deepest = routed.agg(F.max(F.size("path"))).first()[0] or 0
    at = lambda f, j: f(F.try_element_at("path", F.lit(j + 1)))
    leaves = routed.groupBy("dim", "leaf").agg(F.count("*").alias("n"), *[at(f, j).alias(f"{name}{j}") for j in range(deepest) for name, f in (("low", F.min), ("high", F.max))]).collect()
    for dim, top in tops.items():
        own = {r.leaf: r.asDict() for r in leaves if r.dim == dim}
        top.bound({x: tuple([r[f"{name}{j}"] for j in range(deepest) if r[f"low{j}"] is not None] for name in ("low", "high")) for x, r in own.items()})
    bounded = spark.sparkContext.broadcast(tops)
    shards = spark.createDataFrame([(r.dim, r.leaf, math.ceil(r.n / shard_rows)) for r in leaves], "dim int, leaf int, shards int")
    trees = stash(build_trees(routed, shards), "ann-trees")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                if dim in bounded.value:  # no row is of another length
                    leaf, _ = bounded.value[dim].route(_matrix(part, "vector", dim), queries=True)
                    yield pa.record_batch([*part.columns, pa.array(leaf), pa.array(np.full(len(leaf), -np.inf))], [*part.schema.names, "leaf", "floor"])

    # Equal query rows are searched once; what they find is given to each.
    columns = "key long, query_id long, vector array<double>, dim int, copies long"
    asked = clean(queries).groupBy("vec_id", "vector", "dim").agg(F.count("*").alias("copies")).select(F.xxhash64("vec_id", "vector").alias("key"), F.col("vec_id").alias("query_id"), "vector", "dim", "copies")
    asked = stash(asked.mapInArrow(home, columns + ", leaf int, floor double"), "ann-asked")
    near = _search(asked, trees, shards, k, factor)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                floor, leaf = np.asarray(part.column("floor")), np.asarray(part.column("leaf"))
                rest = [[x for x in own if x != h] for own, h in zip(bounded.value[dim].open(_matrix(part, "vector", dim), floor, factor), leaf.tolist())]
                yield pa.record_batch([*part.columns, pa.array(rest, pa.list_(pa.int32()))], [*part.schema.names, "rest"])

    if any(t.leaves > 1 for t in tops.values()):
        full = near.groupBy("key", "query_id").agg(F.min("score").alias("_floor"), F.count("*").alias("_n")).where(F.col("_n") >= k)
        known = asked.drop("floor").join(full.select("key", "query_id", "_floor"), ["key", "query_id"], "left").select("key", "query_id", "vector", "dim", "copies", "leaf", F.coalesce("_floor", F.lit(float("-inf"))).alias("floor"))
        known = stash(known.mapInArrow(others, columns + ", leaf int, floor double, rest array<int>"), "ann-open")
        if seen is not None:
            seen["searched"], seen["are"] = known.agg(F.sum(F.size("rest") + 1)).first()[0], sum(known.where(F.col("dim") == d).count() * t.leaves for d, t in tops.items())
        more = _search(known.withColumn("leaf", F.explode("rest")).drop("rest"), trees, shards, k, factor)
        near = _best(near.drop("rank").unionByName(more.drop("rank")), k)
    copies = asked.select("key", "query_id", F.explode(F.expr("sequence(1L, copies)")))
    return near.join(copies.select("key", "query_id"), ["key", "query_id"]).select("query_id", "rank", "vec_id", "score")


def op9_vantage_trees(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))


OP9_SQL = """
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, len(embedding) AS dim FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM fine q JOIN fine c ON q.dim = c.dim AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
