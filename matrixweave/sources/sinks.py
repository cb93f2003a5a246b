"""Written forms: graphs with dense ids in both directions, point tables by region, and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixweave.operators.spatial import symmetric


def graph_tables(nodes: DataFrame, edges: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sample_id, node, id, …) with dense 0-based nodes a sample, and (sample_id, source, target, …) both ways.

    A ``label`` column must have one value a sample.
    """
    if label:
        mixed = nodes.groupBy("sample_id").agg(F.countDistinct(label).alias("n")).where("n > 1").limit(1).collect()
        if mixed:
            raise ValueError(f"sample {mixed[0].sample_id} has more than one {label}")
    numbered = nodes.withColumn("node", F.row_number().over(Window.partitionBy("sample_id").orderBy("id")) - 1)
    both = symmetric(edges)
    for end, name in (("src", "source"), ("dst", "target")):
        both = both.join(numbered.select("sample_id", F.col("id").alias(end), F.col("node").alias(name)), ["sample_id", end])
    return numbered, both.drop("src", "dst")


def padded(column: str, width: int):
    """An array padded with zeros to ``width``."""
    return F.concat(F.coalesce(column, F.array()), F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(F.coalesce(column, F.array())), F.lit(0))))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, label: str | None = None) -> None:
    n, e = graph_tables(nodes, edges, label)
    n.write.partitionBy("sample_id").parquet(f"{path}/nodes")
    e.write.partitionBy("sample_id").parquet(f"{path}/edges")


def region_points(patches: DataFrame) -> DataFrame:
    """(region, instance_id, x, y, ecm_cluster): instances count from 0 in each region."""
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy("patch_id")) - 1
    return patches.select(F.col("sample_id").alias("region"), rank.alias("instance_id"), "x", "y", "ecm_cluster")


def write_layers(tiles: DataFrame, path: str) -> None:
    tiles.write.partitionBy("layer").parquet(path)
