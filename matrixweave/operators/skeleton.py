"""Skeleton features of pixel blocks: thinning is a neighbourhood iteration, so blocks are thinned many at a time in Arrow groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixweave.operators.patches import BLOCK


def thin(masks: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning of n x h x w masks."""
    m = np.pad(masks.astype(np.uint8), ((0, 0), (1, 1), (1, 1)))
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = m.copy()
        for a, b in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6))):
            p = np.stack([np.roll(m, (-dy, -dx), axis=(1, 2)) for dy, dx in ring])
            count = p.sum(axis=0)
            turns = ((p == 0) & (np.roll(p, -1, axis=0) == 1)).sum(axis=0)
            off = (m == 1) & (count >= 2) & (count <= 6) & (turns == 1) & (p[list(a)].prod(axis=0) == 0) & (p[list(b)].prod(axis=0) == 0)
            m[off] = 0
        if (m == before).all():
            return m[:, 1:-1, 1:-1].astype(bool)


def block_skeletons(rows: DataFrame, size: int) -> DataFrame:
    """skeleton_density, branchpoint_density and mean_branch_length of pixels over their block's mean.

    A branch point has three or more skeleton neighbours; a mean branch is the
    skeleton's pixels over its branch points plus one, 0 without a skeleton.
    """
    names = ["skeleton_density", "branchpoint_density", "mean_branch_length"]
    one = rows.groupBy(*BLOCK).agg(F.transform(F.array_sort(F.collect_list(F.struct("py", "px", "v"))), lambda s: s["v"]).alias("v"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column(4).to_pylist(), float).reshape(-1, size, size)
            bone = thin(v > v.mean(axis=(1, 2), keepdims=True))
            wide = np.pad(bone.astype(int), ((0, 0), (1, 1), (1, 1)))
            near = sum(np.roll(wide, (dy, dx), axis=(1, 2)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)[:, 1:-1, 1:-1]
            n, branch = bone.sum(axis=(1, 2)), (bone & (near >= 3)).sum(axis=(1, 2))
            columns = [n / size**2, branch / size**2, np.where(n > 0, n / (branch + 1), 0.0)]
            yield pa.record_batch([*batch.columns[:4], *map(pa.array, columns)], [*BLOCK, *names])

    kinds = dict(one.dtypes)
    return one.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in BLOCK), *(f"{c} double" for c in names)]))
