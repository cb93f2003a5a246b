"""Named extractors of patch features, and users' own ones."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matrixweave.operators import patches
from matrixweave.operators.patches import BLOCK

#: Takes rows of blocks, gives BLOCK and one or more features of each.
Extractor = Callable[[DataFrame], DataFrame]

_KNOWN: dict[str, Extractor] = {
    "moments": patches.block_moments,
    "entropy": patches.block_entropy,
    "gradients": patches.block_gradients,
    "texture": patches.block_texture,
}


def register(name: str, extractor: Extractor) -> None:
    _KNOWN[name] = extractor


def resolve(names: Iterable[str | Extractor]) -> list[Extractor]:
    """The extractors of these names; what can be called is one itself."""
    names = list(names)
    unknown = [n for n in names if not callable(n) and n not in _KNOWN]
    if unknown or not names:
        raise ValueError(f"extractors are {', '.join(sorted(_KNOWN))}, not {', '.join(map(str, unknown)) or 'none'}")
    return [n if callable(n) else _KNOWN[n] for n in names]


def of_array(name: str, fn: Callable[[np.ndarray], float]) -> Extractor:
    """An extractor from a function of a block's pixels, an array of rows; pixels that are missing are nan."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        y, x = (np.asarray(table.column(c)).astype(np.int64) for c in ("py", "px"))
        image = np.full((y.max() + 1, x.max() + 1), np.nan)
        image[y, x] = np.asarray(table.column("v"), float)
        return pa.table([*([k] for k in key), [float(fn(image))]], names=[*BLOCK, name])

    def extract(rows: DataFrame) -> DataFrame:
        kinds = dict(rows.dtypes)
        own = rows.select(*BLOCK, "py", "px", "v")
        return own.groupBy(*BLOCK).applyInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in BLOCK), f"`{name}` double"]))

    return extract


def extract(rows: DataFrame, names: Iterable[str | Extractor]) -> DataFrame:
    """BLOCK and the features of all these extractors; a feature that two of them give is an error.

    All group by the block, so the joins find their sides dealt as they need them.
    """
    parts = [e(rows) for e in resolve(names)]
    seen = [c for p in parts for c in p.columns if c not in BLOCK]
    twice = sorted({c for c in seen if seen.count(c) > 1})
    if twice:
        raise ValueError(f"features are given more than once: {', '.join(twice)}")
    return functools.reduce(lambda a, b: a.join(b, BLOCK), parts)
