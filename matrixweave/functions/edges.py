"""Scalar features and weights of an edge, as columns of its ends' positions.

Ends are (ax, ay) and (bx, by); d is their distance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def _dx() -> Column:
    return F.col("bx") - F.col("ax")


def _dy() -> Column:
    return F.col("by") - F.col("ay")


def _theta() -> Column:
    return F.atan2(_dy(), _dx())


#: Each name's column; ``register`` adds more.
FEATURES: dict[str, Callable[[], Column]] = {
    "log_distance": lambda: F.log1p("d"),
    "norm_angle": lambda: (_theta() + F.pi()) / (2 * F.pi()),
    "distance": lambda: F.col("d"),
    "dx_norm": lambda: _dx() / (F.col("d") + EPS),
    "dy_norm": lambda: _dy() / (F.col("d") + EPS),
    "sin_angle": lambda: F.sin(_theta()),
    "cos_angle": lambda: F.cos(_theta()),
    "sin_angle2": lambda: F.sin(2 * _theta()),
    "cos_angle2": lambda: F.cos(2 * _theta()),
    "inv_distance": lambda: 1 / (F.col("d") + EPS),
    "manhattan_distance": lambda: F.abs(_dx()) + F.abs(_dy()),
}


def register(name: str, build: Callable[[], Column]) -> None:
    FEATURES[name] = build


def exp_neg_distance(sigma: float = 100.0) -> Callable[[], Column]:
    return lambda: F.exp(-F.col("d") / F.lit(float(sigma)))


def features(names: list[str]) -> list[Column]:
    unknown = [n for n in names if n not in FEATURES]
    if unknown:
        raise KeyError(f"no edge feature is named {', '.join(unknown)}; there are {', '.join(FEATURES)}")
    return [FEATURES[n]().alias(n) for n in names]


def weight(kind: str | Callable[[], Column] = "inv_distance") -> Column:
    """inv_distance is 0 where the ends coincide."""
    if callable(kind):
        return kind()
    kinds = {"inv_distance": F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(0.0), "distance": F.col("d"), "uniform": F.lit(1.0)}
    if kind not in kinds:
        raise ValueError(f"edge weights are {', '.join(kinds)} or a function, not {kind!r}")
    return kinds[kind]
