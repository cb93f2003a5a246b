"""Graph models without a deep-learning library: mean-aggregating layers, trained in NumPy, one task a (seed, fold).

``classify`` predicts a graph's class from its nodes under group folds; ``importance``
attributes it to the nodes' features by integrated gradients; ``encode_masked`` learns
node embeddings by filling in masked features.  A cohort of graphs has to fit a task,
as it does where such models are used; what is spread over the cluster are seeds and folds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Room:
    """Memory that is used again and again, since fresh pages cost as much as sums of their size."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, use: str, rows: int, wide: int) -> np.ndarray:
        if use not in self.held or self.held[use].size < rows * wide:
            self.held[use] = np.empty(rows * wide)
        return self.held[use][: rows * wide].reshape(rows, wide)


class Sums:
    """Weighted sums of rows ``source`` into rows ``to`` of a table of ``n``, a slot at a time: the j-th terms of all sums together.

    A sum of more than ``most`` terms is cut into pieces, which are summed likewise, so that there are few slots.
    """

    def __init__(self, to: np.ndarray, source: np.ndarray, weight: np.ndarray, n: int, room: Room | None = None, most: int = 64):
        self.room = room or Room()
        order = np.argsort(to, kind="stable")
        to, source, weight = to[order], source[order], weight[order]
        first = np.flatnonzero(np.concatenate((np.full(min(len(to), 1), True), np.diff(to) != 0)))
        at = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        begin = np.flatnonzero(at % most == 0)
        count = np.diff(np.append(begin, len(to)))
        order = np.argsort(-count, kind="stable")
        begin, count, self.n, self.slots = begin[order], count[order], n, []
        for j in range(int(count.max(initial=0))):
            terms = begin[: np.searchsorted(-count, -j)] + j
            self.slots.append((source[terms], weight[terms, None] if (weight[terms] != 1).any() else None))
        self.to, self.above = to[begin], None
        if len(first) < len(begin):
            self.above = Sums(self.to, np.arange(len(begin)), np.ones(len(begin)), n, most=most)
        self.whole = self.above is None and len(begin) == n and bool((self.to == np.arange(n)).all())

    def _pieces(self, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
        more = self.room("more", *out.shape)
        for j, (terms, weight) in enumerate(self.slots):
            got = (more if j else out)[: len(terms)]
            np.take(rows, terms, axis=0, out=got, mode="clip")  # all are in range; the mode spares a copy
            if weight is not None:
                got *= weight
            if j:
                out[: len(terms)] += got
        return out

    def add(self, rows: np.ndarray, into: np.ndarray) -> None:
        pieces = self._pieces(rows, self.room("pieces", len(self.to), rows.shape[1]))
        if self.above:
            self.above.add(pieces, into)
        else:
            into[self.to] += pieces

    def __call__(self, rows: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        out = np.empty((self.n, rows.shape[1])) if out is None else out
        if self.whole:
            return self._pieces(rows, out)
        out.fill(0)
        self.add(rows, out)
        return out


class Means:
    """The mean over each node's neighbours, and its transpose, from directed edges; every layer has the same nodes."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        weight = 1.0 / np.maximum(np.bincount(src, minlength=n), 1)[src]
        self.forward, self.backward = Sums(src, dst, weight, n), Sums(dst, src, weight, n)

    def at(self, layer: int) -> Means:
        return self

    def own(self, h: np.ndarray) -> np.ndarray:
        return h

    def disown(self, g: np.ndarray) -> np.ndarray:
        return g


class Part:
    """Some rows of a level: ``up`` from the layer below, ``down`` adds their gradients (which it spoils) to its sums."""

    def __init__(self, rows: slice, below: np.ndarray, to: np.ndarray, cols: np.ndarray, count: np.ndarray, degree: np.ndarray, wide: int, room: Room):
        n = len(below)
        self.rows, self.below, self.share, self.room = rows, below, 1 / np.maximum(degree, 1)[:, None], room
        self.forward, self.backward = Sums(to, cols, count, n, room), Sums(cols, to, count, wide, room)
        self.disown = Sums(below, np.arange(n), np.ones(n), wide, room)

    def up(self, own: np.ndarray, near: np.ndarray) -> np.ndarray:
        shape = len(self.below), own.shape[1]
        out = self.forward(near, self.room("up", *shape))
        out *= self.share
        out += np.take(own, self.below, axis=0, out=self.room("more", *shape), mode="clip")
        return out

    def down(self, d: np.ndarray, own: np.ndarray, near: np.ndarray) -> None:
        self.disown.add(d, own)
        d *= self.share
        self.backward.add(d, near)


class Level:
    """One layer over kinds of nodes: ``own`` kind in the layer below, and the mean over the neighbours' kinds there.

    Its rows lie in parts small enough for a processor's cache.  ``rows``, the row of each cell, ascends.
    """

    def __init__(self, below: np.ndarray, rows: np.ndarray, cols: np.ndarray, count: np.ndarray, degree: np.ndarray, wide: int, step: int = 1 << 12):
        self.n, self.wide, self.parts, room = len(below), wide, [], Room()
        for a in range(0, self.n, step):
            own = slice(a, min(a + step, self.n))
            cells = slice(*np.searchsorted(rows, (own.start, own.stop)))
            self.parts.append(Part(own, below[own], rows[cells] - a, cols[cells], count[cells].astype(float), degree[own], wide, room))

    def own(self, h: np.ndarray) -> np.ndarray:
        return np.concatenate([h[p.below] for p in self.parts]) if self.parts else h[:0]

    def forward(self, h: np.ndarray) -> np.ndarray:
        return np.concatenate([p.forward(h) * p.share for p in self.parts]) if self.parts else h[:0]

    def disown(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((self.wide, g.shape[1]))
        for p in self.parts:
            p.disown.add(g[p.rows], out)
        return out

    def backward(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((self.wide, g.shape[1]))
        for p in self.parts:
            p.backward.add(g[p.rows] * p.share, out)
        return out


def _codes(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row, and each row's number among them."""
    here, code = np.zeros(min(len(columns[0]), 1), np.int64), np.zeros(len(columns[0]), np.int64)
    for c in columns:
        values, number = np.unique(c, return_inverse=True)
        _, here, code = np.unique(code * len(values) + number, return_index=True, return_inverse=True)
    return here, code


class Kinds:
    """Nodes that a network of mean-aggregating layers cannot tell apart, computed once a layer.

    Two nodes are of one kind at layer 0 if their features are equal, and at layer k if
    they are of one kind at k - 1 and so are their neighbours, with their numbers.  Numbers
    of neighbours by kind are compared by two 64-bit sums of random values.  ``x`` has a row a kind
    of layer 0, ``of`` each node's kind at the last layer; kinds of many cells come first.
    """

    def __init__(self, x: np.ndarray, src: np.ndarray, dst: np.ndarray, layers: int = 2):
        n, rng = len(x), np.random.default_rng(0)
        here, kind = _codes(list(x.T) or [np.zeros(n)])
        self.x, self.levels, degree = x[here], [], np.bincount(src, minlength=n)
        order = np.argsort(src, kind="stable")
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.concatenate((np.full(min(len(src), 1), True), np.diff(src) != 0)))
        for _ in range(layers):
            wide = int(kind.max(initial=-1)) + 1
            sign = np.zeros((2, n), np.uint64)
            for k in range(2):
                value = rng.integers(0, 1 << 64, wide, np.uint64)
                if len(src):
                    sign[k, src[first]] = np.add.reduceat(value[kind[dst]], first)
            here, after = _codes([kind, *sign])
            shown = np.zeros(n, bool)
            shown[here] = True
            edge = shown[src]
            cells, count = np.unique(after[src[edge]] * wide + kind[dst[edge]], return_counts=True)
            if count.max(initial=0) <= 4:  # terms without a factor are summed faster
                cells, count = np.repeat(cells, count), np.ones(count.sum(), np.int64)
            rows, cols = cells // max(wide, 1), cells % max(wide, 1)
            # Numbered by how many cells they have, so that each slot of a sum is a run of rows.
            order = np.argsort(-np.bincount(rows, minlength=len(here)), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            here, after, rows = here[order], place[after], place[rows]
            order = np.argsort(rows, kind="stable")
            self.levels.append(Level(kind[here], rows[order], cols[order], count[order], degree[here], wide))
            kind = after
        self.of, self.n = kind, self.levels[-1].n if self.levels else len(self.x)

    def at(self, layer: int) -> Level:
        return self.levels[layer]


class Network:
    """A linear layer, ``layers`` of relu(h A + mean(h) B + c), and a linear head; Adam trains it."""

    def __init__(self, wide: int, out: int, hidden: int = 32, layers: int = 2, seed: int = 0):
        rng = np.random.default_rng(seed)
        make = lambda a, b: rng.normal(0, np.sqrt(2 / (a + b)), (a, b))
        self.layers = layers
        self.p = {"W": make(wide, hidden), "w": np.zeros(hidden), "O": make(hidden, out), "o": np.zeros(out)}
        for k in range(layers):
            self.p |= {f"A{k}": make(hidden, hidden), f"B{k}": make(hidden, hidden), f"c{k}": np.zeros(hidden)}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def _rise(self, x: np.ndarray, means: Means, layers: int) -> list[np.ndarray]:
        """The input, and the values of the linear layer and of so many layers after it."""
        kept = [x, np.maximum(x @ self.p["W"] + self.p["w"], 0)]
        for k in range(layers):
            # Multiplied before rows are gathered, since the layer below has no more rows than this one.
            h = means.at(k).own(kept[-1] @ self.p[f"A{k}"]) + means.at(k).forward(kept[-1] @ self.p[f"B{k}"]) + self.p[f"c{k}"]
            kept.append(np.maximum(h, 0))
        return kept

    def _through(self, k: int, h: np.ndarray, own: np.ndarray, near: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of layer ``k``'s matrices and of its input ``h``, from those of its own rows and of the means."""
        return {f"A{k}": h.T @ own, f"B{k}": h.T @ near}, own @ self.p[f"A{k}"].T + near @ self.p[f"B{k}"].T

    def _fall(self, d: np.ndarray, kept: list[np.ndarray], means: Means) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of the input, from those of the last values kept."""
        out = {}
        for k in reversed(range(len(kept) - 2)):
            d = d * (kept[k + 2] > 0)
            out[f"c{k}"] = d.sum(axis=0)
            got, d = self._through(k, kept[k + 1], means.at(k).disown(d), means.at(k).backward(d))
            out |= got
        d = d * (kept[1] > 0)
        return out | {"W": kept[0].T @ d, "w": d.sum(axis=0)}, d @ self.p["W"].T

    def forward(self, x: np.ndarray, means: Means) -> tuple[np.ndarray, list]:
        kept = self._rise(x, means, self.layers)
        return kept[-1] @ self.p["O"] + self.p["o"], kept

    def backward(self, g: np.ndarray, kept: list, means: Means) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of the input, from those of the output."""
        out, d = self._fall(g @ self.p["O"].T, kept, means)
        return out | {"O": kept[-1].T @ g, "o": g.sum(axis=0)}, d

    def _last(self, x: np.ndarray, kinds: Kinds):
        """The values kept below the last layer, and the last layer's, a part at a time, so that they are never all held."""
        k = self.layers - 1
        kept = self._rise(x, kinds, k)
        own, near = kept[-1] @ self.p[f"A{k}"], kept[-1] @ self.p[f"B{k}"]

        def parts():
            for part in kinds.at(k).parts:
                after = part.up(own, near)
                after += self.p[f"c{k}"]
                yield part, np.maximum(after, 0, out=after)

        return kept, parts()

    def scores(self, x: np.ndarray, kinds: Kinds) -> np.ndarray:
        """The output, as of ``forward``."""
        return np.concatenate([np.zeros((0, len(self.p["o"]))), *(after @ self.p["O"] + self.p["o"] for _, after in self._last(x, kinds)[1])])

    def gradients(self, x: np.ndarray, kinds: Kinds, slope) -> dict:
        """Gradients of the parameters; ``slope`` has those of the output from some rows (a slice) and their output."""
        k = self.layers - 1
        kept, parts = self._last(x, kinds)
        own, near = np.zeros_like(kept[-1]), np.zeros_like(kept[-1])
        out = {name: np.zeros_like(self.p[name]) for name in ("O", "o")}
        for part, after in parts:
            g = slope(part.rows, after @ self.p["O"] + self.p["o"])
            d = np.matmul(g, self.p["O"].T, out=part.room("down", *after.shape))
            np.copyto(d, 0, where=after <= 0)
            out["O"] += after.T @ g
            out["o"] += g.sum(axis=0)
            part.down(d, own, near)
        got, d = self._through(k, kept[-1], own, near)
        return out | got | {f"c{k}": own.sum(axis=0)} | self._fall(d, kept, kinds)[0]

    def pulls(self, x: np.ndarray, kinds: Kinds, share: np.ndarray) -> np.ndarray:
        """For each output, the gradient of its sum, weighted by ``share``, at ``x``; outputs differ below the head by a factor a column only."""
        k = self.layers - 1
        kept, parts = self._last(x, kinds)
        own, near = np.zeros_like(kept[-1]), np.zeros_like(kept[-1])
        for part, after in parts:
            d = part.room("down", *after.shape)
            d[:] = share[part.rows, None]
            np.copyto(d, 0, where=after <= 0)
            part.down(d, own, near)
        return np.stack([self._fall(self._through(k, kept[-1], own * o, near * o)[1], kept, kinds)[1] for o in self.p["O"].T])

    def step(self, grads: dict, rate: float, decay: float) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g + decay * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] = self.p[k] - rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _arrays(nodes: pa.Table, edges: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(graph, node, class, x, fold, src, dst) with nodes in the order of (graph, node), and edges both ways as places there."""
    graph, node = (np.asarray(nodes.column(c)) for c in ("graph", "node"))
    order = np.lexsort((node, graph))
    x = np.asarray(nodes.column("x").combine_chunks().flatten()).astype(float).reshape(len(graph), -1)[order]
    graph, node = graph[order], node[order]
    graphs, names = np.unique(graph), np.unique(node)
    key = np.searchsorted(graphs, graph) * len(names) + np.searchsorted(names, node)
    ends = []
    for c in ("src", "dst"):
        g, v = np.asarray(edges.column("graph")), np.asarray(edges.column(c))
        found = np.searchsorted(key, np.searchsorted(graphs, g) * len(names) + np.searchsorted(names, v))
        found = np.minimum(found, max(len(key) - 1, 0))
        if len(g) and not (len(key) and (graph[found] == g).all() and (node[found] == v).all()):
            raise KeyError(f"an edge's {c} is no node of its graph")
        ends.append(found.astype(np.int64))
    src, dst = ends
    return graph, node, np.asarray(nodes.column("label"))[order], x, np.asarray(nodes.column("in_fold"))[order].astype(bool), np.concatenate([src, dst]), np.concatenate([dst, src])


def _part(pick: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the picked nodes, numbered among them; graphs are picked whole."""
    place, keep = np.cumsum(pick) - 1, pick[src]
    return place[src[keep]], place[dst[keep]]


def _train(x, label, test, src, dst, epochs, rate, decay, seed) -> tuple[Network, np.ndarray]:
    """A network of the nodes outside the fold, with balanced class weights and features scaled by theirs.

    Graphs are not joined to each other, so that those of the fold, without weight in the loss, take no part.
    """
    fit = ~test
    mean, sd = x[fit].mean(axis=0), x[fit].std(axis=0)
    x = (x - mean) / np.where(sd > 0, sd, 1)
    k = int(label.max()) + 1
    own = label[fit]
    weight = (fit.sum() / (k * np.maximum(np.bincount(own, minlength=k), 1)))[own]
    weight /= weight.sum()
    kinds = Kinds(x[fit], *_part(fit, src, dst))
    # The loss of a kind's nodes together.
    target = np.stack([np.bincount(kinds.of[own == c], weight[own == c], kinds.n) for c in range(k)], axis=1)
    whole = target.sum(axis=1, keepdims=True)
    net = Network(x.shape[1], k, seed=seed)
    for _ in range(epochs):
        net.step(net.gradients(kinds.x, kinds, lambda rows, z: softmax(z) * whole[rows] - target[rows]), rate, decay)
    return net, x


def _probabilities(net: Network, x: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    kinds = Kinds(x, src, dst)
    return softmax(net.scores(kinds.x, kinds))[kinds.of]


def _by_run(nodes: DataFrame, edges: DataFrame, folds: DataFrame, seeds: int, run, schema: str) -> DataFrame:
    """``run`` of all nodes and edges for each (seed, fold); the fold's nodes are marked."""
    spark = nodes.sparkSession
    pairs = [(s, r[0]) for r in folds.select("fold").distinct().orderBy("fold").collect() for s in range(seeds)]
    runs = lambda: F.broadcast(spark.createDataFrame(pairs, "seed int, fold int"))
    own = nodes.join(folds.select("graph", F.col("fold").alias("_f")), "graph").crossJoin(runs()).withColumn("in_fold", (F.col("_f") == F.col("fold")).cast("int")).drop("_f")
    return own.groupBy("seed", "fold").cogroup(edges.crossJoin(runs()).groupBy("seed", "fold")).applyInArrow(run, schema)


def classify(nodes: DataFrame, edges: DataFrame, folds: DataFrame, seeds: int = 1, epochs: int = 120, rate: float = 0.005, decay: float = 1e-4) -> DataFrame:
    """(seed, fold, graph, node, p) of the nodes of each fold by a model of the others.

    ``nodes(graph, node, label, x array)``, label 0 to k - 1; ``edges(graph, src, dst)``
    once each; ``folds(graph, fold)``.
    """

    def run(key: tuple, n: pa.Table, e: pa.Table) -> pa.Table:
        seed, fold = (k.as_py() for k in key)
        graph, node, label, x, test, src, dst = _arrays(n, e)
        net, x = _train(x, label, test, src, dst, epochs, rate, decay, seed)
        p = _probabilities(net, x[test], *_part(test, src, dst))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.reshape(-1)))
        return pa.table({"seed": pa.array(np.full(len(p), seed, np.int32)), "fold": pa.array(np.full(len(p), fold, np.int32)), "graph": graph[test], "node": node[test], "p": lists})

    return _by_run(nodes, edges, folds, seeds, run, "seed int, fold int, graph long, node long, p array<double>")


def importance(nodes: DataFrame, edges: DataFrame, folds: DataFrame, steps: int = 50, epochs: int = 120, rate: float = 0.005, decay: float = 1e-4) -> DataFrame:
    """(graph, class, feature, attribution): integrated gradients from zero of the mean class score, summed over the graph's nodes; each graph by the model that hasn't seen it."""

    def run(key: tuple, n: pa.Table, e: pa.Table) -> pa.Table:
        graph, _, label, x, test, src, dst = _arrays(n, e)
        net, x = _train(x, label, test, src, dst, epochs, rate, decay, key[0].as_py())
        rows, k = [], int(label.max()) + 1
        for g in np.unique(graph[test]):
            own = graph == g
            kinds = Kinds(x[own], *_part(own, src, dst))
            share = np.bincount(kinds.of, minlength=kinds.n) / own.sum()
            total = np.zeros((k, *kinds.x.shape))
            for s in range(steps):
                total += net.pulls(kinds.x * ((s + 0.5) / steps), kinds, share)
            rows += [(int(g), c, f, float(v)) for c in range(k) for f, v in enumerate((kinds.x * total[c] / steps).sum(axis=0))]
        return pa.Table.from_pylist([dict(zip(("graph", "class", "feature", "attribution"), r)) for r in rows], schema=pa.schema([("graph", pa.int64()), ("class", pa.int32()), ("feature", pa.int32()), ("attribution", pa.float64())]))

    return _by_run(nodes, edges, folds, 1, run, "graph long, class int, feature int, attribution double")


def predictions(scored: DataFrame) -> DataFrame:
    """(graph, p, predicted): the seeds' and nodes' mean probabilities of each graph, and their largest."""
    long = scored.select("graph", "node", F.posexplode("p").alias("c", "v")).groupBy("graph", "node", "c").agg(F.avg("v").alias("v")).groupBy("graph", "c").agg(F.avg("v").alias("v"))
    best = Window.partitionBy("graph").orderBy(F.desc("v"), "c")
    return long.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("graph", F.col("v").alias("p"), F.col("c").alias("predicted"))


def encode_masked(nodes: DataFrame, edges: DataFrame, hidden: int = 16, share: float = 0.5, epochs: int = 150, rate: float = 0.001, decay: float = 1e-4, seed: int = 0) -> DataFrame:
    """(sample_id, node, z): embeddings of each sample's nodes by a network that fills in masked standardised features; z is standardised."""

    def run(key: tuple, n: pa.Table, e: pa.Table) -> pa.Table:
        if not n.num_rows:
            return pa.table({"sample_id": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "z": pa.array([], pa.list_(pa.float64()))})
        n = n.append_column("graph", n.column("sample_id")).append_column("label", pa.array(np.zeros(n.num_rows, np.int64))).append_column("in_fold", pa.array(np.zeros(n.num_rows, np.int32)))
        e = e.append_column("graph", e.column("sample_id"))
        graph, node, _, x, _, src, dst = _arrays(n, e)
        means = Means(len(x), src, dst)
        scale = lambda v: (v - v.mean(axis=0)) / (v.std(axis=0) + 1e-8)
        x, rng = scale(x), np.random.default_rng(seed)
        net = Network(x.shape[1], x.shape[1], hidden, seed=seed)
        for _ in range(epochs):
            hide = rng.random(len(x)) < share
            if hide.any():
                out, kept = net.forward(np.where(hide[:, None], 0.0, x), means)
                g = np.where(hide[:, None], 2 * (out - x) / (hide.sum() * x.shape[1]), 0.0)
                net.step(net.backward(g, kept, means)[0], rate, decay)
        z = scale(net.forward(x, means)[1][-1])
        return pa.table({"sample_id": graph, "node": node, "z": pa.array(z.tolist(), pa.list_(pa.float64()))})

    own = nodes.select(F.col("sample_id").cast("long").alias("sample_id"), "node", "x")
    ends = edges.select(F.col("sample_id").cast("long").alias("sample_id"), "src", "dst")
    return own.groupBy("sample_id").cogroup(ends.groupBy("sample_id")).applyInArrow(run, "sample_id long, node long, z array<double>")


class PatchEncoder:
    """Embeddings of patches' pixels by principal components.

    A linear substitute for a convolutional encoder, which needs a library that is not
    at hand; it is fitted, applied, saved and loaded in the same way.
    """

    def __init__(self, latent: int = 16, model: PCAModel | None = None):
        self.latent, self.model = latent, model

    def fit(self, patches: DataFrame, column: str = "pixels") -> PatchEncoder:
        self.model = PCA(k=self.latent, inputCol=column, outputCol="latent").fit(patches)
        return self

    def transform(self, patches: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("the encoder has not been fitted")
        return self.model.transform(patches)

    def save(self, path: str, overwrite: bool = False) -> None:
        writer = self.model.write()
        (writer.overwrite() if overwrite else writer).save(path)

    @classmethod
    def load(cls, path: str) -> PatchEncoder:
        model = PCAModel.load(path)
        return cls(model.getK(), model)
