"""Checks of inputs: positions, masks, node types, adjacencies, splits, and which table a named value is from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrixweave.operators.joint import CELL, PATCH


def _finite(name: str) -> Column:
    v = F.col(name).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def finite_positions(points: DataFrame, *axes: str) -> DataFrame:
    """``points``, whose ``axes`` (x and y, unless named) must be there and finite in every row."""
    axes = axes or ("x", "y")
    missing = [a for a in axes if a not in points.columns]
    if missing or len(axes) < 2:
        raise ValueError(f"positions need two columns or more; missing: {', '.join(missing) or 'a second one'}")
    bad = points.agg(*[F.count_if(~_finite(a)).alias(a) for a in axes]).first().asDict()
    if any(bad.values()):
        raise ValueError("positions that are null or not finite: " + ", ".join(f"{n} of {a}" for a, n in bad.items() if n))
    return points


def sources(rows: DataFrame, mask: str) -> DataFrame:
    """The rows whose boolean ``mask`` is true; a null one is an error, raised where the row is read."""
    if dict(rows.dtypes).get(mask) != "boolean":
        raise ValueError(f"{mask} is no boolean column")
    return rows.where(F.when(F.col(mask).isNull(), F.raise_error(F.lit(f"{mask} has a null")).cast("boolean")).otherwise(F.col(mask)))


def of_types(nodes: DataFrame, *types: str) -> DataFrame:
    """The nodes of these types; a type that no graph has is an error."""
    unknown = sorted(set(types) - {CELL, PATCH})
    if unknown or not types:
        raise ValueError(f"node types are {CELL} and {PATCH}, not {', '.join(unknown) or 'none'}")
    return nodes.where(F.col("node_type").isin(*types))


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sample_id, src, dst, weight) without zeros; both ends must be nodes, and weights finite and not negative."""
    own = edges.select("sample_id", "src", "dst", F.col("weight").cast("double").alias("weight"))
    bad = own.where(~_finite("weight") | (F.col("weight") < 0)).count()
    ends = own.select("sample_id", F.explode(F.array("src", "dst")).alias("id"))
    lost = ends.join(nodes.select("sample_id", "id"), ["sample_id", "id"], "left_anti").distinct().count()
    if bad or lost:
        raise ValueError(f"{bad} weights are negative or not finite, {lost} ends are no nodes")
    return own.where("weight <> 0")


def value_of(tables: dict[str, DataFrame], name: str, source: str | None = None) -> DataFrame:
    """(sample_id, id, value) of column ``name`` in the one table that has it, or in ``tables[source]``."""
    if source is not None and source not in tables:
        raise ValueError(f"sources are {', '.join(tables)}, not {source}")
    found = [t for t in ([source] if source else tables) if name in tables[t].columns]
    if len(found) != 1:
        raise ValueError(f"{name} is in {' and '.join(found) if found else 'no table'}")
    own = tables[found[0]]
    if own.columns.count(name) > 1:
        raise ValueError(f"{found[0]} has {name} more than once")
    return own.select("sample_id", "id", F.col(name).alias("value"))


def split_report(folds: DataFrame) -> DataFrame:
    """(fold, n_test, n_train, test_classes, train_classes, shared_groups, fine) of ``folds(graph, label, grp, fold)``.

    Each fold is tested on its own graphs and trained on all others.  It is fine if both
    sides hold every class and no group is on both sides.  Only counts by fold, class and
    group are joined, never graphs.
    """
    by = folds.groupBy("fold", "label").agg(F.count("*").alias("n"))
    total = folds.groupBy("label").agg(F.count("*").alias("t"))
    names = by.select("fold").distinct()
    full = names.crossJoin(F.broadcast(total)).join(by, ["fold", "label"], "left")
    n = F.coalesce("n", F.lit(0))
    sides = full.groupBy("fold").agg(
        F.sum(n).alias("n_test"), F.sum(F.col("t") - n).alias("n_train"), F.count_if(n > 0).alias("test_classes"), F.count_if(F.col("t") > n).alias("train_classes"), F.count("*").alias("_k")
    )
    held = folds.select("grp", "fold").distinct()
    twice = held.groupBy("grp").agg(F.count("*").alias("_m")).where("_m > 1").select("grp")
    shared = held.join(twice, "grp").groupBy("fold").agg(F.count("*").alias("shared_groups"))
    out = sides.join(shared, "fold", "left").withColumn("shared_groups", F.coalesce("shared_groups", F.lit(0)))
    return out.withColumn("fine", (F.col("test_classes") == F.col("_k")) & (F.col("train_classes") == F.col("_k")) & (F.col("shared_groups") == 0)).drop("_k")


def valid_splits(folds: DataFrame) -> DataFrame:
    """``folds``, which must be two or more, fine, and hold each graph once."""
    twice = folds.groupBy("graph").count().where("count > 1").limit(1).count()
    report = split_report(folds).select("fold", "fine").collect()  # one row a fold
    bad = sorted(str(r.fold) for r in report if not r.fine)
    if twice or bad or len(report) < 2:
        raise ValueError(f"splits are not valid: {len(report)} folds, not fine {', '.join(bad) or 'none'}, graphs more than once: {'yes' if twice else 'no'}")
    return folds


def cap_of(method: str, cap: float | None, name: str = "cap") -> float | None:
    """``cap``; only the method knn takes one."""
    if cap is not None and method != "knn":
        raise ValueError(f"{name} is of knn only, not of {method}")
    return cap
