"""Tables of a cohort and those behind its figures: attached patches, facts, values at places, bars, heat maps."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matrixweave.operators.joint import PATCH

#: Adjusted p-values under these get three, two and one star: fixed values.
STARS = (0.001, 0.01, 0.05)


def empty_cells(spark: SparkSession, features: Iterable[str]) -> DataFrame:
    """Cells of an image whose mask has none: the columns and types of others, no rows."""
    return spark.createDataFrame([], ", ".join(["sample_id int", "id long", "x double", "y double", "area long", *(f"`{f}` double" for f in features)]))


def attach_patches(cells: DataFrame, patches: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``patches``, whose samples must be those of ``cells``, and the joint ``edges`` that are still true: those between cells."""
    a, b = cells.select("sample_id").distinct(), patches.select("sample_id").distinct()
    differ = a.unionByName(b).groupBy("sample_id").count().where("count = 1").limit(5).collect()
    if differ:
        raise ValueError(f"samples of one side only: {', '.join(str(r[0]) for r in differ)}")
    return patches, edges.where((F.col("src_type") != PATCH) & (F.col("dst_type") != PATCH))


def mask_at(points: DataFrame, mask: DataFrame) -> DataFrame:
    """``points(sample_id, id, x, y)`` with the ``mask(sample_id, y, x, v)`` at the pixel that they lie in.

    Positions are cut to whole pixels and those outside go to the border; a point whose
    sample has no mask, or whose pixel the mask lacks, has null.
    """
    edge = mask.groupBy("sample_id").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    at = lambda v, most: F.least(F.greatest(F.col(v).cast("int"), F.lit(0)), F.col(most))
    own = points.select("sample_id", "id", "x", "y").join(edge, "sample_id", "left").withColumns({"_y": at("y", "_h"), "_x": at("x", "_w")})
    there = mask.select("sample_id", F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("v").alias("value"))
    return own.join(there, ["sample_id", "_y", "_x"], "left").select("sample_id", "id", "x", "y", "value")


def by_sample_apply(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn`` (pandas table to pandas table) of every sample; a sample is one task's."""
    return rows.groupBy("sample_id").applyInPandas(fn, schema)


def facts(cells: DataFrame, patches: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: groups and samples that have cells, cells, cell types, patches, share of background patches."""
    own = samples.join(cells.select("sample_id").distinct(), "sample_id", "left_semi")
    a = own.agg(F.countDistinct("grp").alias("n_groups"), F.countDistinct("sample_id").alias("n_samples"))
    b = cells.agg(F.count("*").alias("n_cells"), F.countDistinct("cell_type").alias("n_types"))
    c = patches.agg(F.count("*").alias("n_patches"), F.avg((F.col("ecm_cluster") < 0).cast("double")).alias("background"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def bars(results: DataFrame, by: str = "model", metric: str = "roc_auc", order: str = "pos") -> DataFrame:
    """(by, rank, mean, sd, n): rank in the order in which a model is first seen; one value has sd 0."""
    out = results.groupBy(by).agg(F.min(order).alias("_at"), F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("sd"), F.count(metric).alias("n"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy("_at", by))).drop("_at")  # a row a model


def by_roi(enriched: DataFrame, cell_type: str, clusters: int) -> DataFrame:
    """(sample_id, c0, c1, …): a cell type's log2 enrichment by sample and cluster, null where it was not measured."""
    own = enriched.where(F.col("cell_type") == cell_type).groupBy("sample_id").pivot("cluster", list(range(clusters))).agg(F.max("log2"))
    return own.toDF("sample_id", *[f"c{k}" for k in range(clusters)])


def stars(q: str) -> Column:
    """``***``, ``**``, ``*`` or nothing for an adjusted p."""
    out = F.lit("")
    for k, level in enumerate(reversed(STARS), 1):
        out = F.when(F.col(q) < level, "*" * k).otherwise(out)
    return out


def heat_map(matrix: DataFrame, order_by: int | None = None, most: float = 4.0, value: str = "log2", q: str = "p_fdr") -> DataFrame:
    """(cell_type, cluster, row, shown, mark): rows by descending value in cluster ``order_by``, else by name; values cut at ±``most``.

    A cell type without a value there comes last.
    """
    key = F.lit(0.0) if order_by is None else F.max(F.when(F.col("cluster") == order_by, F.col(value)))
    order = matrix.groupBy("cell_type").agg(key.alias("_k"))
    order = order.withColumn("row", F.row_number().over(Window.orderBy(F.desc_nulls_last("_k"), "cell_type"))).select("cell_type", "row")  # a row a cell type
    shown = F.least(F.greatest(F.col(value), F.lit(-most)), F.lit(most))
    return matrix.join(order, "cell_type").select("cell_type", "cluster", "row", shown.alias("shown"), stars(q).alias("mark"))


def graph_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """(sample_id, added, gone, kept) of undirected edges, for a graph that takes another's place."""
    side = lambda df, name: df.select("sample_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn(name, F.lit(1))
    both = side(new, "a").join(side(old, "b"), ["sample_id", "src", "dst"], "full")
    return both.groupBy("sample_id").agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("gone"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"))


def node_number(node: str) -> Column:
    """The number in a node's name, such as 12 in ``ecm_12``; null where there is none."""
    return F.nullif(F.regexp_extract(node, r"_(\d+)$", 1), F.lit("")).cast("long")
