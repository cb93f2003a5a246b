"""Core tables (cells, patches, edges, pixels, points) derived from the driver's star schema.

Each table has a Spark form and the same arithmetic as DuckDB SQL (``*_SQL``), so that
every query can be held against SQL.  The star schema holds no tissue; what is tested
here is arithmetic and scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of a patch in pixels, and patches a row of the lattice.
PATCH, LATTICE = 8, 50
#: Moduli of the cells' coordinates: primes, so that few cells coincide.
X_MOD, Y_MOD = 1009, 997
SAMPLES = 8
PIXELS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, cell_id, cell_type, x, y, marker) from customer: as many samples as the patches have."""
    return table(spark, sf_dir, "customer").select(
        (F.col("c_nationkey") % SAMPLES).cast("int").alias("sample_id"),
        F.col("c_custkey").alias("cell_id"),
        F.col("c_mktsegment").alias("cell_type"),
        (F.col("c_custkey") * 37 % X_MOD).cast("double").alias("x"),
        (F.col("c_custkey") * 91 % Y_MOD).cast("double").alias("y"),
        F.col("c_acctbal").alias("marker"),
    )


CELLS_SQL = f"""cells AS (
  SELECT CAST(c_nationkey % {SAMPLES} AS INTEGER) AS sample_id, c_custkey AS cell_id, c_mktsegment AS cell_type,
         CAST(c_custkey * 37 % {X_MOD} AS DOUBLE) AS x, CAST(c_custkey * 91 % {Y_MOD} AS DOUBLE) AS y, c_acctbal AS marker
  FROM customer)"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, patch_id, ecm_cluster, grid_y, grid_x, x, y, f0, f1) from part; cluster -1 is background."""
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % SAMPLES).cast("int").alias("sample_id"),
        F.col("p_partkey").alias("patch_id"),
        (F.col("p_size") % 6 - 1).alias("ecm_cluster"),
        F.expr(f"cast(p_partkey div {SAMPLES} div {LATTICE} as int)").alias("grid_y"),
        F.expr(f"cast(p_partkey div {SAMPLES} % {LATTICE} as int)").alias("grid_x"),
        F.expr(f"cast(p_partkey div {SAMPLES} % {LATTICE} * {PATCH} + {PATCH // 2} as double)").alias("x"),
        F.expr(f"cast(p_partkey div {SAMPLES} div {LATTICE} * {PATCH} + {PATCH // 2} as double)").alias("y"),
        F.col("p_retailprice").alias("f0"),
        F.col("p_size").cast("double").alias("f1"),
    )


PATCHES_SQL = f"""patches AS (
  SELECT CAST(p_partkey % {SAMPLES} AS INTEGER) AS sample_id, p_partkey AS patch_id, p_size % 6 - 1 AS ecm_cluster,
         CAST(p_partkey // {SAMPLES} // {LATTICE} AS INTEGER) AS grid_y, CAST(p_partkey // {SAMPLES} % {LATTICE} AS INTEGER) AS grid_x,
         CAST(p_partkey // {SAMPLES} % {LATTICE} * {PATCH} + {PATCH // 2} AS DOUBLE) AS x,
         CAST(p_partkey // {SAMPLES} // {LATTICE} * {PATCH} + {PATCH // 2} AS DOUBLE) AS y,
         p_retailprice AS f0, CAST(p_size AS DOUBLE) AS f1
  FROM part)"""


def cross_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, src cell, dst patch) of cells that ordered a part, once each; the patch is the part's neighbour in the cell's sample, if there is one."""
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), "l_partkey")
    pairs = bought.join(cells(spark, sf_dir).select("sample_id", F.col("cell_id").alias("src")).hint("merge"), "src")
    pairs = pairs.select("sample_id", "src", F.expr(f"l_partkey - l_partkey % {SAMPLES} + sample_id").alias("dst")).distinct()
    return pairs.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dst")).hint("merge"), "dst", "left_semi").select("sample_id", "src", "dst")


CROSS_SQL = f"""cross_edges AS (
  SELECT DISTINCT CAST(c_nationkey % {SAMPLES} AS INTEGER) AS sample_id, c_custkey AS src, l_partkey - l_partkey % {SAMPLES} + c_nationkey % {SAMPLES} AS dst
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  WHERE l_partkey - l_partkey % {SAMPLES} + c_nationkey % {SAMPLES} IN (SELECT p_partkey FROM part))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, id, x, y, value) from the first components of embeddings; one sample a label."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("sample_id"), F.col("vec_id").alias("id"), (e[0].cast("double") * 100).alias("x"), (e[1].cast("double") * 100).alias("y"), e[2].cast("double").alias("value")
    )


POINTS_SQL = """points AS (
  SELECT label AS sample_id, vec_id AS id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y,
         CAST(embedding[3] AS DOUBLE) AS value
  FROM embeddings)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, channel, y, x, v) from events: images of PIXELS x PIXELS, one a sample."""
    side = PIXELS * PIXELS
    return table(spark, sf_dir, "events").select(
        F.expr(f"cast(event_id div {side} as int)").alias("sample_id"),
        F.lit(0).alias("channel"),
        F.expr(f"cast(event_id % {side} div {PIXELS} as int)").alias("y"),
        F.expr(f"cast(event_id % {PIXELS} as int)").alias("x"),
        F.col("value").alias("v"),
    )


PIXELS_SQL = f"""pixels AS (
  SELECT CAST(event_id // {PIXELS * PIXELS} AS INTEGER) AS sample_id, 0 AS channel,
         CAST(event_id % {PIXELS * PIXELS} // {PIXELS} AS INTEGER) AS y, CAST(event_id % {PIXELS} AS INTEGER) AS x, value AS v
  FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, grp) from nation and region."""
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("sample_id"), F.col("r_name").alias("grp"))


SAMPLES_SQL = "samples AS (SELECT n_nationkey AS sample_id, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey)"


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, id, score, label) from labels and documents: a score for each truth, one sample a source."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id").select(
        F.col("source").alias("sample_id"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label")
    )


TRUTH_SQL = """truth AS (
  SELECT source AS sample_id, doc_id AS id, CAST(n_chars AS DOUBLE) AS score, toxic AS label
  FROM labels JOIN documents USING (doc_id))"""
