"""Written form of a joint graph by node type and relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hetero_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``node``, from 0 by id in each sample and type; relations) of a joint graph.

    relations: (sample_id, relation, source, target, d, weight), relation such as
    ``cell-ecm``.  Edges of one type are there both ways, edges between types as two
    relations, one the other's reverse.
    """
    numbered = nodes.withColumn("node", (F.row_number().over(Window.partitionBy("sample_id", "node_type").orderBy("id")) - 1).cast("long"))
    ids = numbered.select("sample_id", "node_type", "id", "node")
    # Joined while each edge is one row; then both ways.
    found = edges.select("sample_id", "src_type", "src", "dst_type", "dst", "d", "weight")
    for end, name in (("src", "source"), ("dst", "target")):
        found = found.join(ids.select("sample_id", F.col("node_type").alias(f"{end}_type"), F.col("id").alias(end), F.col("node").alias(name)).hint("merge"), ["sample_id", f"{end}_type", end])
    way = lambda a, b, at, to: F.struct(F.concat_ws("-", f"{a}_type", f"{b}_type").alias("relation"), F.col(at).alias("source"), F.col(to).alias("target"))
    ways = F.explode(F.array(way("src", "dst", "source", "target"), way("dst", "src", "target", "source"))).alias("e")
    return numbered, found.select("sample_id", ways, "d", "weight").select("sample_id", "e.*", "d", "weight")


def write_hetero(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder a sample and type, or relation."""
    n, e = hetero_tables(nodes, edges)
    n.write.partitionBy("sample_id", "node_type").parquet(f"{path}/nodes")
    e.write.partitionBy("sample_id", "relation").parquet(f"{path}/relations")
