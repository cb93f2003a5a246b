"""The registered queries of the library's operators, over whole tables, and the SQL that DuckDB runs against them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixweave.functions import edges as edge_functions
from matrixweave.functions import scale
from matrixweave.operators import checks, cluster, cohort, communities, denoise, extractors, filters, frames, geometry, graph, joint, nn, patches, skeleton, spatial, stats, structures, thresholds, tiled
from matrixweave.plans import adapters as at
from matrixweave.plans.scratch import written
from matrixweave.sources import hetero, images, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

RADIUS, NEAREST, CLUSTERS, BLOCK = 3.0, 5, 5, 10
AROUND_CELL, SIDE = 20.0, 5
#: Permutations of the tests, and their seed: the reference's own numbers.
PERMUTATIONS, INTERACTION_PERMUTATIONS, SEED = 5000, 1000, 7


def query(name: str, sql: str | None = None, *tables: str) -> Callable[[Query], Query]:
    """Register a query; ``tables`` are the core tables that its SQL starts with."""

    def keep(build: Query) -> Query:
        QUERIES[name] = build
        if sql:
            head = ",\n".join(tables)
            ORACLE_SQL[name] = f"WITH RECURSIVE {head}{', ' if 'AS (' in sql.split('SELECT')[0] and head else ' '}{sql}" if head else sql
        return build

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


C, P, X, PT, PX, S, T = at.CELLS_SQL, at.PATCHES_SQL, at.CROSS_SQL, at.POINTS_SQL, at.PIXELS_SQL, at.SAMPLES_SQL, at.TRUTH_SQL
#: Undirected edges of points within RADIUS, of the patches' lattice, and blocks of pixels, in SQL.
RADIUS_SQL = f"""radius_edges AS (
  SELECT a.sample_id, a.id AS src, b.id AS dst, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by", sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d
  FROM points a JOIN points b ON a.sample_id = b.sample_id AND a.id < b.id
  WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= {RADIUS * RADIUS})"""
LATTICE_SQL = """grid_edges AS (
  SELECT a.sample_id, least(a.patch_id, b.patch_id) AS src, greatest(a.patch_id, b.patch_id) AS dst
  FROM patches a JOIN patches b ON a.sample_id = b.sample_id
   AND (b.grid_y - a.grid_y, b.grid_x - a.grid_x) IN ((0, 1), (1, 0), (1, 1), (1, -1)))"""
BOTH_SQL = "both_ways AS (SELECT sample_id, src, dst FROM grid_edges UNION ALL SELECT sample_id, dst, src FROM grid_edges)"
KNN_SQL = f"""near AS (
  SELECT a.sample_id, a.id AS src, b.id AS dst, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d,
         row_number() OVER (PARTITION BY a.sample_id, a.id ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.id) AS rank
  FROM points a JOIN points b ON a.sample_id = b.sample_id AND a.id <> b.id)"""
BLOCKS_SQL = f"""sized AS (SELECT sample_id, max(y) + 1 AS h, max(x) + 1 AS w FROM pixels GROUP BY sample_id),
blocks AS (
  SELECT p.sample_id, channel, y // {BLOCK} AS "by", x // {BLOCK} AS bx, y % {BLOCK} AS py, x % {BLOCK} AS px, v
  FROM pixels p JOIN sized s ON p.sample_id = s.sample_id WHERE y // {BLOCK} < h // {BLOCK} AND x // {BLOCK} < w // {BLOCK})"""


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return at.patches(spark, sf).select("sample_id", F.col("patch_id").alias("id"), F.col("ecm_cluster").alias("label"))


def lattice(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.grid_edges(at.patches(spark, sf))


def placed(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges with their ends' positions."""
    for end, p in (("src", "a"), ("dst", "b")):
        edges = edges.join(points.select("sample_id", F.col("id").alias(end), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y")), ["sample_id", end])
    return edges


def block_rows(spark: SparkSession, sf: str) -> DataFrame:
    return patches.blocks(at.pixels(spark, sf), BLOCK)


# Spatial joins.


@query("radius_edges", "SELECT sample_id, src, dst, round(d, 6) AS d FROM radius_edges", PT, RADIUS_SQL)
def _(spark, sf):
    return rounded(spatial.radius_edges(at.points(spark, sf), RADIUS))


@query("knn_edges", f"""SELECT DISTINCT sample_id, least(src, dst) AS src, greatest(src, dst) AS dst, round(d, 6) AS d FROM near WHERE rank <= {NEAREST}""", PT, KNN_SQL)
def _(spark, sf):
    return rounded(spatial.knn_edges(at.points(spark, sf), NEAREST))


@query("knn_edges_capped", f"""SELECT DISTINCT sample_id, least(src, dst) AS src, greatest(src, dst) AS dst, round(d, 6) AS d FROM near WHERE rank <= {NEAREST} AND d <= 4""", PT, KNN_SQL)
def _(spark, sf):
    return rounded(spatial.knn_edges(at.points(spark, sf), NEAREST, cap=4.0))


@query("knn_bipartite", f"""SELECT sample_id, src, dst, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM (
  SELECT a.sample_id, a.id AS src, b.id AS dst, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d,
         row_number() OVER (PARTITION BY a.sample_id, a.id ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.id) AS rank
  FROM points a JOIN points b ON a.sample_id = b.sample_id WHERE a.id % 3 = 0 AND b.id % 3 <> 0) q WHERE rank <= {NEAREST}""", PT)
def _(spark, sf):
    p = at.points(spark, sf)
    return rounded(spatial.nearest(p.where("id % 3 = 0"), p.where("id % 3 <> 0"), NEAREST))


@query("grid_edges_8", "SELECT sample_id, src, dst FROM grid_edges", P, LATTICE_SQL)
def _(spark, sf):
    return lattice(spark, sf)


@query("grid_edges_4", """SELECT a.sample_id, least(a.patch_id, b.patch_id) AS src, greatest(a.patch_id, b.patch_id) AS dst
  FROM patches a JOIN patches b ON a.sample_id = b.sample_id AND (b.grid_y - a.grid_y, b.grid_x - a.grid_x) IN ((0, 1), (1, 0))""", P)
def _(spark, sf):
    return spatial.grid_edges(at.patches(spark, sf), 4)


@query("radius_bipartite", f"""SELECT c.sample_id, cell_id AS src, patch_id AS dst, round(sqrt((c.x-p.x)*(c.x-p.x) + (c.y-p.y)*(c.y-p.y)), 6) AS d
  FROM cells c JOIN patches p ON c.sample_id = p.sample_id WHERE (c.x-p.x)*(c.x-p.x) + (c.y-p.y)*(c.y-p.y) <= {AROUND_CELL * AROUND_CELL}""", C, P)
def _(spark, sf):
    a, b = at.cells(spark, sf).withColumnRenamed("cell_id", "id"), at.patches(spark, sf).withColumnRenamed("patch_id", "id")
    return rounded(spatial.range_join(a, b, AROUND_CELL))


@query("adopt_adjacency", """SELECT e.sample_id, e.src, e.dst, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)), 6) AS d FROM (
  SELECT DISTINCT sample_id, least(src, dst) AS src, greatest(src, dst) AS dst FROM near WHERE rank <= 2) e
  JOIN points a ON a.sample_id = e.sample_id AND a.id = e.src JOIN points b ON b.sample_id = e.sample_id AND b.id = e.dst""", PT, KNN_SQL)
def _(spark, sf):
    p = at.points(spark, sf)
    return rounded(spatial.adopt_adjacency(spatial.nearest(p, p, 2, own=True), p))


@query("edge_features", """SELECT sample_id, src, dst, round(ln(1 + d), 6) AS log_distance, round((atan2("by"-ay, bx-ax) + pi()) / (2*pi()), 6) AS norm_angle,
  round(d, 6) AS distance, round((bx-ax)/(d+1e-8), 6) AS dx_norm, round(("by"-ay)/(d+1e-8), 6) AS dy_norm, round(sin(atan2("by"-ay, bx-ax)), 6) AS sin_angle,
  round(cos(atan2("by"-ay, bx-ax)), 6) AS cos_angle, round(sin(2*atan2("by"-ay, bx-ax)), 6) AS sin_angle2, round(cos(2*atan2("by"-ay, bx-ax)), 6) AS cos_angle2,
  round(1/(d+1e-8), 6) AS inv_distance, round(abs(bx-ax) + abs("by"-ay), 6) AS manhattan_distance, round(exp(-d/100), 6) AS exp_neg_distance,
  round(CASE WHEN d > 0 THEN 1/d ELSE 0 END, 6) AS weight FROM radius_edges""", PT, RADIUS_SQL)
def _(spark, sf):
    p = at.points(spark, sf)
    edges = placed(spatial.radius_edges(p, RADIUS), p)
    return rounded(edges.select("sample_id", "src", "dst", *edge_functions.features(list(edge_functions.FEATURES)), edge_functions.exp_neg_distance()().alias("exp_neg_distance"), edge_functions.weight().alias("weight")))


@query("edge_features_standardised", """SELECT sample_id, src, dst, round((ln(1+d) - avg(ln(1+d)) OVER ()) / (stddev_pop(ln(1+d)) OVER () + 1e-8), 6) AS log_distance,
  round((sin(2*atan2("by"-ay, bx-ax)) - avg(sin(2*atan2("by"-ay, bx-ax))) OVER ()) / (stddev_pop(sin(2*atan2("by"-ay, bx-ax))) OVER () + 1e-8), 6) AS sin_angle2 FROM radius_edges""", PT, RADIUS_SQL)
def _(spark, sf):
    p = at.points(spark, sf)
    edges = placed(spatial.radius_edges(p, RADIUS), p).select("sample_id", "src", "dst", *edge_functions.features(["log_distance", "sin_angle2"]))
    m = edges.agg(*[f(c).alias(f"_{n}_{c}") for c in ("log_distance", "sin_angle2") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = edges.crossJoin(F.broadcast(m))  # one row of moments
    return rounded(out.select("sample_id", "src", "dst", *[((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-8)).alias(c) for c in ("log_distance", "sin_angle2")]))


@query("transfer_radius", f"""SELECT t.sample_id, t.id, count(s.id) AS n_sources, round(avg(s.value), 6) AS mean, round(sum(s.value), 6) AS sum, round(max(s.value), 6) AS max
  FROM points t LEFT JOIN points s ON s.sample_id = t.sample_id AND s.id % 2 = 0 AND (s.x-t.x)*(s.x-t.x) + (s.y-t.y)*(s.y-t.y) <= {RADIUS * RADIUS}
  WHERE t.id % 2 = 1 GROUP BY t.sample_id, t.id""", PT)
def _(spark, sf):
    p = at.points(spark, sf)
    return rounded(spatial.transfer(p.where("id % 2 = 0"), p.where("id % 2 = 1"), RADIUS))


@query("transfer_nearest", """SELECT t.sample_id, t.id, round(n.value, 6) AS nearest, round(n.d, 6) AS d, CASE WHEN n.d IS NULL THEN 0 ELSE 1 END AS n_sources FROM points t LEFT JOIN (
  SELECT a.sample_id, a.id, b.value, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d,
         row_number() OVER (PARTITION BY a.sample_id, a.id ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.id) AS rank
  FROM points a JOIN points b ON a.sample_id = b.sample_id WHERE a.id % 2 = 1 AND b.id % 2 = 0) n
  ON n.sample_id = t.sample_id AND n.id = t.id AND n.rank = 1 AND n.d <= 5 WHERE t.id % 2 = 1""", PT)
def _(spark, sf):
    p = at.points(spark, sf)
    return rounded(spatial.transfer_nearest(p.where("id % 2 = 0"), p.where("id % 2 = 1"), cap=5.0))


@query("edge_continuity", f"""steps AS (SELECT e.sample_id, src, dst, CAST(round_even(ay + ("by" - ay) * (i / 5.0::DOUBLE), 0) AS INTEGER) AS y, CAST(round_even(ax + (bx - ax) * (i / 5.0::DOUBLE), 0) AS INTEGER) AS x
  FROM radius_edges e, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i) q),
fg AS (SELECT DISTINCT sample_id, CAST(round_even(y, 0) AS INTEGER) AS y, CAST(round_even(x, 0) AS INTEGER) AS x FROM points)
SELECT s.sample_id, src, dst, round(avg(CASE WHEN f.y IS NULL THEN 0.0 ELSE 1.0 END), 6) AS continuity
FROM steps s LEFT JOIN fg f ON f.sample_id = s.sample_id AND f.y = s.y AND f.x = s.x GROUP BY s.sample_id, src, dst""", PT, RADIUS_SQL)
def _(spark, sf):
    p = at.points(spark, sf)
    fg = p.select("sample_id", F.bround("y", 0).cast("int").alias("y"), F.bround("x", 0).cast("int").alias("x")).distinct()
    return rounded(spatial.edge_continuity(placed(spatial.radius_edges(p, RADIUS), p), fg))


# Graph measures.

COMPONENTS_SQL = """walk AS (
  SELECT sample_id, id, id AS root FROM points
  UNION SELECT e.sample_id, e.other, w.root FROM walk w JOIN (
    SELECT sample_id, src AS one, dst AS other FROM radius_edges UNION ALL SELECT sample_id, dst, src FROM radius_edges) e
  ON e.sample_id = w.sample_id AND e.one = w.id),
groups AS (SELECT sample_id, id, min(root) AS component FROM walk GROUP BY sample_id, id)"""


@query("components", "SELECT * FROM groups", PT, RADIUS_SQL, COMPONENTS_SQL)
def _(spark, sf):
    p = at.points(spark, sf)
    return graph.components(p, spatial.radius_edges(p, RADIUS))


RECORDS_SQL = """records AS (
  SELECT p.sample_id, g.component, count(*) AS n_nodes, round(avg(p.x), 6) AS x, round(avg(p.y), 6) AS y,
    (SELECT count(*) FROM radius_edges e JOIN groups h ON h.sample_id = e.sample_id AND h.id = e.src WHERE e.sample_id = p.sample_id AND h.component = g.component) AS n_edges
  FROM points p JOIN groups g ON g.sample_id = p.sample_id AND g.id = p.id GROUP BY p.sample_id, g.component)"""


@query("components_reconnected", "SELECT *, n_nodes >= 3 AS kept FROM records", PT, RADIUS_SQL, COMPONENTS_SQL, RECORDS_SQL)
def _(spark, sf):
    return rounded(graph.components_reconnected(at.points(spark, sf), RADIUS, 3))


@query("largest_component", """SELECT sample_id, component, n_nodes, n_edges, x, y, n_nodes >= 3 AS kept FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n_nodes DESC, component) AS r FROM records) q WHERE r = 1""", PT, RADIUS_SQL, COMPONENTS_SQL, RECORDS_SQL)
def _(spark, sf):
    return rounded(graph.largest_component(graph.components_reconnected(at.points(spark, sf), RADIUS, 3)))


@query("component_size_by_sample", "SELECT sample_id, CAST(coalesce(sum(CASE WHEN n_nodes >= 3 THEN n_nodes END), 0) AS BIGINT) AS size FROM records GROUP BY sample_id", PT, RADIUS_SQL, COMPONENTS_SQL, RECORDS_SQL)
def _(spark, sf):
    records = graph.components_reconnected(at.points(spark, sf), RADIUS, 3)
    return records.groupBy("sample_id").agg(F.coalesce(F.sum(F.when(F.col("kept"), F.col("n_nodes"))), F.lit(0)).alias("size"))


@query("degrees", """SELECT p.sample_id, p.id, count(e.src) AS degree FROM points p LEFT JOIN radius_edges e
  ON e.sample_id = p.sample_id AND (e.src = p.id OR e.dst = p.id) GROUP BY p.sample_id, p.id""", PT, RADIUS_SQL)
def _(spark, sf):
    p = at.points(spark, sf)
    return graph.degrees(p, spatial.radius_edges(p, RADIUS))


TOPOLOGY_SQL = """deg AS (SELECT p.sample_id, p.id, count(e.src) AS degree FROM points p LEFT JOIN radius_edges e ON e.sample_id = p.sample_id AND (e.src = p.id OR e.dst = p.id) GROUP BY p.sample_id, p.id),
tri AS (SELECT e.sample_id, e.src AS a, e.dst AS b, f.dst AS c FROM radius_edges e JOIN radius_edges f ON f.sample_id = e.sample_id AND f.src = e.dst
  JOIN radius_edges g ON g.sample_id = e.sample_id AND g.src = e.src AND g.dst = f.dst),
corner AS (SELECT sample_id, id, count(*) AS t FROM (SELECT sample_id, unnest([a, b, c]) AS id FROM tri) q GROUP BY sample_id, id),
loc AS (SELECT d.sample_id, avg(CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0.0 END) AS clustering, sum(coalesce(t, 0)) AS corners,
  count(*) AS n, avg(degree) AS mean_degree, max(degree) AS max_degree, stddev_pop(degree) AS sd_degree, sum(degree * (degree - 1) / 2.0) AS wedges
  FROM deg d LEFT JOIN corner USING (sample_id, id) GROUP BY d.sample_id),
len AS (SELECT sample_id, count(*) AS m, avg(d) AS mean_length, quantile_cont(d, 0.5) AS median_length, max(d) AS max_length FROM radius_edges GROUP BY sample_id)
SELECT l.sample_id, n AS n_nodes, coalesce(m, 0) AS n_edges, round(CASE WHEN n > 1 THEN 2.0 * coalesce(m, 0) / (n * (n - 1)) ELSE 0.0 END, 6) AS density, round(mean_degree, 6) AS mean_degree,
  max_degree, round(sd_degree, 6) AS sd_degree, round(mean_length, 6) AS mean_length, round(median_length, 6) AS median_length, round(max_length, 6) AS max_length,
  round(CASE WHEN n > 2 THEN clustering END, 6) AS clustering, round(CASE WHEN n > 2 THEN CASE WHEN wedges > 0 THEN corners / wedges ELSE 0.0 END END, 6) AS transitivity
FROM loc l LEFT JOIN len USING (sample_id)"""


@query("topology", TOPOLOGY_SQL, PT, RADIUS_SQL)
def _(spark, sf):
    p = at.points(spark, sf)
    return rounded(graph.topology(p, spatial.radius_edges(p, RADIUS)))


@query("core_numbers", """ends AS (SELECT sample_id, src AS id, dst AS other FROM radius_edges UNION ALL SELECT sample_id, dst, src FROM radius_edges),
peel AS (SELECT 0 AS step, p.sample_id, p.id, count(e.other) AS core FROM points p LEFT JOIN ends e ON e.sample_id = p.sample_id AND e.id = p.id GROUP BY 1, 2, 3
  UNION ALL SELECT step + 1, sample_id, id, coalesce(max(CASE WHEN core < r THEN core ELSE r END) FILTER (WHERE core IS NOT NULL), 0) FROM (
    SELECT w.step, w.sample_id, w.id, o.core, row_number() OVER (PARTITION BY w.sample_id, w.id ORDER BY o.core DESC NULLS LAST) AS r
    FROM peel w LEFT JOIN ends e ON e.sample_id = w.sample_id AND e.id = w.id LEFT JOIN peel o ON o.sample_id = e.sample_id AND o.id = e.other WHERE w.step < 40) q GROUP BY 1, 2, 3)
SELECT sample_id, id, core FROM peel WHERE step = 40""", PT, RADIUS_SQL)
def _(spark, sf):
    p = at.points(spark, sf)
    return graph.core_numbers(p, spatial.radius_edges(p, RADIUS))


MODULARITY_SQL = """joined AS (SELECT e.sample_id, a.ecm_cluster AS la, b.ecm_cluster AS lb FROM grid_edges e JOIN patches a ON a.patch_id = e.src JOIN patches b ON b.patch_id = e.dst),
inside AS (SELECT sample_id, count(*) AS m, sum((la = lb)::INT) AS n FROM joined GROUP BY sample_id),
shares AS (SELECT sample_id, l, count(*) AS deg FROM (SELECT sample_id, unnest([la, lb]) AS l FROM joined) q GROUP BY sample_id, l)"""


@query("modularity", "SELECT s.sample_id, round(least(greatest(first(n) / first(m)::DOUBLE - sum((deg / (2.0 * m)) ** 2), 0.0), 1.0), 6) AS modularity FROM shares s JOIN inside USING (sample_id) GROUP BY s.sample_id", P, LATTICE_SQL, MODULARITY_SQL)
def _(spark, sf):
    return rounded(graph.modularity(labels(spark, sf), lattice(spark, sf)))


@query("coherence", """walk AS (SELECT sample_id, patch_id AS id, ecm_cluster AS label, patch_id AS root FROM patches
  UNION SELECT b.sample_id, b.dst, w.label, w.root FROM walk w JOIN both_ways b ON b.src = w.id JOIN patches p ON p.patch_id = b.dst AND p.ecm_cluster = w.label),
parts AS (SELECT sample_id, label, component, count(*) AS n FROM (SELECT sample_id, label, id, min(root) AS component FROM walk GROUP BY sample_id, label, id) q GROUP BY sample_id, label, component)
SELECT sample_id, label, round(max(n) / sum(n)::DOUBLE, 6) AS coherence FROM parts GROUP BY sample_id, label""", P, LATTICE_SQL, BOTH_SQL)
def _(spark, sf):
    return rounded(graph.coherence(labels(spark, sf), lattice(spark, sf)))


@query("cell_contact", "SELECT c.sample_id, c.cell_id AS id, count(e.dst) AS ecm_degree, CAST(count(e.dst) > 0 AS INTEGER) AS ecm_contact FROM cells c LEFT JOIN cross_edges e ON e.src = c.cell_id GROUP BY c.sample_id, c.cell_id", C, X)
def _(spark, sf):
    return graph.contact(at.cells(spark, sf).withColumnRenamed("cell_id", "id"), at.cross_edges(spark, sf))


@query("smooth_signal", """base AS (SELECT sample_id, patch_id AS id, CASE WHEN patch_id % 7 <> 0 THEN f0 END AS v0 FROM patches),
s1 AS (SELECT b.sample_id, b.id, CASE WHEN b.v0 IS NULL THEN NULL WHEN count(n.v0) = 0 THEN b.v0 ELSE 0.25 * b.v0 + 0.75 * (sum(n.v0) / count(n.v0)) END AS v1
  FROM base b LEFT JOIN both_ways e ON e.src = b.id LEFT JOIN base n ON n.id = e.dst GROUP BY b.sample_id, b.id, b.v0),
s2 AS (SELECT b.sample_id, b.id, CASE WHEN b.v1 IS NULL THEN NULL WHEN count(n.v1) = 0 THEN b.v1 ELSE 0.25 * b.v1 + 0.75 * (sum(n.v1) / count(n.v1)) END AS v2
  FROM s1 b LEFT JOIN both_ways e ON e.src = b.id LEFT JOIN s1 n ON n.id = e.dst GROUP BY b.sample_id, b.id, b.v1)
SELECT sample_id, id, round(v2, 6) AS value FROM s2""", P, LATTICE_SQL, BOTH_SQL)
def _(spark, sf):
    signal = at.patches(spark, sf).select("sample_id", F.col("patch_id").alias("id"), F.when(F.col("patch_id") % 7 != 0, F.col("f0")).alias("value"))
    return rounded(graph.smooth(signal, lattice(spark, sf).withColumn("weight", F.lit(1.0)), 0.75, 2))


@query("neighbour_agreement", """signal AS (SELECT * FROM patches WHERE ecm_cluster <> -1),
rate AS (SELECT s.sample_id, s.patch_id, avg(CASE WHEN n.ecm_cluster IS NOT NULL THEN (n.ecm_cluster = s.ecm_cluster)::INT END) AS r
  FROM signal s LEFT JOIN both_ways e ON e.src = s.patch_id LEFT JOIN signal n ON n.patch_id = e.dst WHERE s.patch_id % 3 = 0 GROUP BY s.sample_id, s.patch_id)
SELECT sample_id, round(avg(r), 6) AS agreement, count(r) AS n_scored, CAST(sum((r IS NULL)::INT) AS BIGINT) AS n_unscored FROM rate GROUP BY sample_id""", P, LATTICE_SQL, BOTH_SQL)
def _(spark, sf):
    return rounded(graph.neighbour_agreement(labels(spark, sf).withColumn("picked", F.col("id") % 3 == 0), lattice(spark, sf)))


@query("joint_graph_summary", """SELECT sample_id, part, count(*) AS n FROM (SELECT sample_id, 'nodes:cell' AS part FROM cells UNION ALL SELECT sample_id, 'nodes:ecm' FROM patches
  UNION ALL SELECT sample_id, 'edges:ecm-ecm' FROM grid_edges UNION ALL SELECT sample_id, 'edges:cell-ecm' FROM cross_edges) q GROUP BY sample_id, part""", C, P, LATTICE_SQL, X)
def _(spark, sf):
    return graph.joint_summary(at.cells(spark, sf), at.patches(spark, sf), {"ecm-ecm": lattice(spark, sf), "cell-ecm": at.cross_edges(spark, sf)})


def _joint(spark, sf):
    cells = at.cells(spark, sf).select("sample_id", F.col("cell_id").alias("id"), "x", "y", F.col("cell_type").alias("label"))
    own = at.patches(spark, sf).select("sample_id", F.col("patch_id").alias("id"), "x", "y", "grid_y", "grid_x", F.col("ecm_cluster").alias("label"))
    return joint.joint_graph(cells, own, k=NEAREST, radius=AROUND_CELL)


@query("joint_graph_nodes", """SELECT sample_id, 'cell' AS node_type, cell_id AS id, x, y, cell_type AS label FROM cells
  UNION ALL SELECT sample_id, 'ecm', patch_id, x, y, CAST(ecm_cluster AS VARCHAR) FROM patches""", C, P)
def _(spark, sf):
    return rounded(_joint(spark, sf)[0])


@query("joint_graph_edges", f"""ranked_cells AS (SELECT a.sample_id, a.cell_id AS i, b.cell_id AS j, row_number() OVER (PARTITION BY a.sample_id, a.cell_id ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.cell_id) AS r
  FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id),
pairs AS (SELECT DISTINCT sample_id, 'cell' AS src_type, least(i, j) AS src, 'cell' AS dst_type, greatest(i, j) AS dst FROM ranked_cells WHERE r <= {NEAREST}
  UNION ALL SELECT sample_id, 'ecm', src, 'ecm', dst FROM grid_edges
  UNION ALL SELECT c.sample_id, 'cell', cell_id, 'ecm', patch_id FROM cells c JOIN patches p ON c.sample_id = p.sample_id WHERE (c.x-p.x)*(c.x-p.x) + (c.y-p.y)*(c.y-p.y) <= {AROUND_CELL * AROUND_CELL}),
spots AS (SELECT sample_id, 'cell' AS kind, cell_id AS id, x, y FROM cells UNION ALL SELECT sample_id, 'ecm', patch_id, x, y FROM patches),
long AS (SELECT p.*, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d FROM pairs p JOIN spots a ON a.sample_id = p.sample_id AND a.kind = src_type AND a.id = src JOIN spots b ON b.sample_id = p.sample_id AND b.kind = dst_type AND b.id = dst)
SELECT CAST(sample_id AS BIGINT) AS sample_id, src_type, src, dst_type, dst, round(d, 6) AS d, round(CASE WHEN d > 0 THEN 1 / d ELSE 0.0 END, 6) AS weight FROM long""", C, P, LATTICE_SQL)
def _(spark, sf):
    return rounded(_joint(spark, sf)[1])


# Contingency statistics and tests.

SHARES_SQL = """counts AS (SELECT sample_id, ecm_cluster AS label, count(*) AS n FROM patches WHERE ecm_cluster >= 0 GROUP BY ALL),
grid AS (SELECT a.sample_id, b.label FROM (SELECT DISTINCT sample_id FROM patches) a, (SELECT DISTINCT label FROM counts) b),
shares AS (SELECT sample_id, label, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY sample_id)::DOUBLE AS share FROM grid LEFT JOIN counts USING (sample_id, label))"""


@query("cluster_composition", "SELECT sample_id, label, round(share, 6) AS share FROM shares", P, SHARES_SQL)
def _(spark, sf):
    return rounded(stats.composition(labels(spark, sf), at.samples(spark, sf))[0])


@query("cluster_composition_groups", "SELECT grp, label, round(avg(share), 6) AS share FROM shares JOIN samples USING (sample_id) GROUP BY grp, label", P, S, SHARES_SQL)
def _(spark, sf):
    return rounded(stats.composition(labels(spark, sf), at.samples(spark, sf))[1])


@query("cooccurrence", f"""own AS (SELECT * FROM patches WHERE ecm_cluster BETWEEN 0 AND {CLUSTERS - 1}),
pairs AS (SELECT a.ecm_cluster AS i, b.ecm_cluster AS j, count(*) AS n FROM grid_edges e JOIN own a ON a.patch_id = e.src JOIN own b ON b.patch_id = e.dst GROUP BY 1, 2),
two AS (SELECT i, j, sum(n) AS n FROM (SELECT i, j, n FROM pairs UNION ALL SELECT j, i, n FROM pairs WHERE i <> j) q GROUP BY i, j),
m AS (SELECT ecm_cluster AS i, count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM own GROUP BY 1)
SELECT a.i, b.i AS j, CAST(coalesce(n, 0) AS DOUBLE) AS observed, round((SELECT sum(n) FROM two) * a.p * b.p, 6) AS expected,
  round(log2((coalesce(n, 0) + 1e-9) / ((SELECT sum(n) FROM two) * a.p * b.p)), 6) AS log2 FROM m a CROSS JOIN m b LEFT JOIN two t ON t.i = a.i AND t.j = b.i""", P, LATTICE_SQL)
def _(spark, sf):
    return rounded(stats.cooccurrence(labels(spark, sf), lattice(spark, sf), CLUSTERS))


@query("interaction_counts", """SELECT t.cell_type, l.label, coalesce(n, 0) AS n FROM (SELECT DISTINCT cell_type FROM cells) t CROSS JOIN (SELECT DISTINCT ecm_cluster AS label FROM patches) l
  LEFT JOIN (SELECT cell_type, ecm_cluster AS label, count(*) AS n FROM cross_edges JOIN cells ON cell_id = src JOIN patches ON patch_id = dst GROUP BY 1, 2) q ON q.cell_type = t.cell_type AND q.label = l.label""", C, P, X)
def _(spark, sf):
    return stats.interactions(at.cells(spark, sf), labels(spark, sf), at.cross_edges(spark, sf))


ENRICH_SQL = f"""by_cell AS (SELECT e.sample_id, e.src AS cell_id, p.ecm_cluster AS cluster, count(*) AS n FROM cross_edges e JOIN patches p ON p.sample_id = e.sample_id AND p.patch_id = e.dst
  WHERE p.ecm_cluster BETWEEN 0 AND {CLUSTERS - 1} GROUP BY 1, 2, 3),
freq AS (SELECT sample_id, cluster, sum(n) / sum(sum(n)) OVER (PARTITION BY sample_id)::DOUBLE AS share FROM by_cell GROUP BY 1, 2)"""


def _enriched_sql(types: str) -> str:
    return f"""met AS (SELECT t.perm, t.sample_id, t.cell_type, b.cluster, sum(b.n) AS n FROM {types} t JOIN by_cell b USING (sample_id, cell_id) GROUP BY 1, 2, 3, 4),
seen AS (SELECT perm, cell_type, cluster, sum(n) AS observed FROM met GROUP BY 1, 2, 3),
target AS (SELECT perm, sample_id, cell_type, sum(n) AS m FROM met GROUP BY 1, 2, 3),
hoped AS (SELECT perm, cell_type, cluster, sum(m * share) AS expected FROM target JOIN freq USING (sample_id) GROUP BY 1, 2, 3),
enriched AS (SELECT h.perm, h.cell_type, h.cluster, CAST(coalesce(observed, 0) AS DOUBLE) AS observed, expected, log2((coalesce(observed, 0) + 1e-9) / (expected + 1e-9)) AS log2
  FROM hoped h LEFT JOIN seen USING (perm, cell_type, cluster))"""


@query("enrichment_descriptive", "SELECT cell_type, CAST(cluster AS INTEGER) AS cluster, observed, round(expected, 6) AS expected, round(log2, 6) AS log2 FROM enriched", C, P, X, ENRICH_SQL, "typed AS (SELECT 0 AS perm, sample_id, cell_id, cell_type FROM cells)", _enriched_sql("typed"))
def _(spark, sf):
    return rounded(stats.enrichment(at.cells(spark, sf), labels(spark, sf), at.cross_edges(spark, sf), CLUSTERS))


@query("enrichment_by_sample", f"""own AS (SELECT e.sample_id, c.cell_type, p.ecm_cluster AS cluster, count(*) AS n FROM cross_edges e JOIN patches p ON p.sample_id = e.sample_id AND p.patch_id = e.dst JOIN cells c ON c.sample_id = e.sample_id AND c.cell_id = e.src
  WHERE p.ecm_cluster BETWEEN 0 AND {CLUSTERS - 1} GROUP BY 1, 2, 3),
full_grid AS (SELECT t.sample_id, t.cell_type, k.cluster, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT sample_id, cell_type FROM cells WHERE sample_id IN (SELECT sample_id FROM own)) t CROSS JOIN (SELECT unnest(range({CLUSTERS})) AS cluster) k
  LEFT JOIN own o ON o.sample_id = t.sample_id AND o.cell_type = t.cell_type AND o.cluster = k.cluster),
hoped AS (SELECT *, sum(n) OVER (PARTITION BY sample_id, cluster) / sum(n) OVER (PARTITION BY sample_id)::DOUBLE * sum(n) OVER (PARTITION BY sample_id, cell_type) AS expected FROM full_grid)
SELECT sample_id, cell_type, CAST(cluster AS INTEGER) AS cluster, CAST(n AS DOUBLE) AS observed, round(expected, 6) AS expected, round(log2((n + 1e-9) / (expected + 1e-9)), 6) AS log2 FROM hoped""", C, P, X)
def _(spark, sf):
    return rounded(stats.enrichment_by_sample(at.cells(spark, sf), labels(spark, sf), at.cross_edges(spark, sf), CLUSTERS))


def _permuted_sql(rows: str, key: str, value: str, n: int) -> str:
    """typed(perm, sample_id, key, value): perm 0 as it was, then ``n`` permutations by the hash of stats.deal_hash."""
    f, g, h, k = stats.FACTORS
    p = stats.PRIME
    return f"""placed AS (SELECT sample_id, {key}, {value}, row_number() OVER (PARTITION BY sample_id ORDER BY {key}) AS pos FROM {rows}),
hash1 AS (SELECT sample_id, {key}, perm, ({key} % {p} * {f} + perm * {g} + {SEED}) % {p} AS a FROM placed, (SELECT unnest(range(1, {n + 1})) AS perm) q),
hash2 AS (SELECT sample_id, {key}, perm, a, (a * a % {p} * {h} + a * {k} + perm) % {p} AS c FROM hash1),
dealt AS (SELECT sample_id, {key}, perm, row_number() OVER (PARTITION BY sample_id, perm ORDER BY (c * c + a) % {p}, {key}) AS r FROM hash2),
typed AS (SELECT d.perm, d.sample_id, d.{key}, p.{value} FROM dealt d JOIN placed p ON p.sample_id = d.sample_id AND p.pos = d.r UNION ALL SELECT 0, sample_id, {key}, {value} FROM placed)"""


FDR_SQL = """ranked AS (SELECT *, max(r0) OVER (PARTITION BY p) AS r, count(*) OVER () AS k FROM (SELECT *, row_number() OVER (ORDER BY p) AS r0 FROM tested) q),
adjusted AS (SELECT *, least(1.0, min(p * k / r) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_fdr FROM ranked)"""
TESTED_SQL = f"""tested AS (SELECT r.cell_type, r.cluster, r.observed, r.expected, r.log2,
  (count(*) FILTER (WHERE abs(round(n.log2, 9)) >= abs(round(r.log2, 9))) + 1) / {PERMUTATIONS + 1}.0::DOUBLE AS p
  FROM enriched r LEFT JOIN enriched n ON n.cell_type = r.cell_type AND n.cluster = r.cluster AND n.perm > 0 WHERE r.perm = 0 GROUP BY ALL)"""
#: Clusters are reported under this adjusted p; the tables hold no planted enrichment, so that nothing is under 0.05.
LEVEL = 0.5
ENRICHED = (C, P, X, ENRICH_SQL, _permuted_sql("cells", "cell_id", "cell_type", PERMUTATIONS), _enriched_sql("typed"), TESTED_SQL, FDR_SQL)


@query("enrichment_matrix", "SELECT cell_type, CAST(cluster AS INTEGER) AS cluster, observed, round(expected, 6) AS expected, round(log2, 6) AS log2, round(p, 6) AS p, round(p_fdr, 6) AS p_fdr FROM adjusted", *ENRICHED)
def _(spark, sf):
    return rounded(stats.enrichment(at.cells(spark, sf), labels(spark, sf), at.cross_edges(spark, sf), CLUSTERS, PERMUTATIONS, SEED))


@query("top_enriched_cluster", f"""SELECT cell_type, CAST(cluster AS INTEGER) AS cluster, observed, round(expected, 6) AS expected, round(log2, 6) AS log2, round(p, 6) AS p, round(p_fdr, 6) AS p_fdr FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY log2 DESC, cluster) AS best FROM adjusted WHERE log2 > 0 AND p_fdr < {LEVEL}) q WHERE best = 1""", *ENRICHED)
def _(spark, sf):
    return rounded(stats.top_cluster(stats.enrichment(at.cells(spark, sf), labels(spark, sf), at.cross_edges(spark, sf), CLUSTERS, PERMUTATIONS, SEED), level=LEVEL))


@query("interaction_test", f"""pool AS (SELECT sample_id, patch_id AS dst, ecm_cluster AS label FROM patches),
{_permuted_sql("pool", "dst", "label", INTERACTION_PERMUTATIONS)},
by_patch AS (SELECT e.sample_id, dst, cell_type, count(*) AS m FROM cross_edges e JOIN cells c ON c.sample_id = e.sample_id AND cell_id = src GROUP BY 1, 2, 3),
grid AS (SELECT * FROM (SELECT DISTINCT cell_type FROM by_patch) a, (SELECT DISTINCT label FROM pool) b, (SELECT unnest(range({INTERACTION_PERMUTATIONS + 1})) AS perm) c),
counts AS (SELECT perm, cell_type, label, sum(m) AS n FROM typed JOIN by_patch USING (sample_id, dst) GROUP BY 1, 2, 3),
filled AS (SELECT perm, cell_type, label, CAST(coalesce(n, 0) AS BIGINT) AS n FROM grid LEFT JOIN counts USING (perm, cell_type, label)),
done AS (SELECT r.cell_type, r.label, r.n, avg((f.n >= r.n)::INT) AS p_enriched, avg((f.n <= r.n)::INT) AS p_depleted FROM filled r JOIN filled f ON f.cell_type = r.cell_type AND f.label = r.label AND f.perm > 0 WHERE r.perm = 0 GROUP BY ALL)
SELECT cell_type, label, n, round(p_enriched, 6) AS p_enriched, round(p_depleted, 6) AS p_depleted, CASE WHEN p_depleted < 0.05 THEN -1 WHEN p_enriched < 0.05 THEN 1 ELSE 0 END AS call FROM done""", C, P, X)
def _(spark, sf):
    return rounded(stats.interaction_test(at.cells(spark, sf), labels(spark, sf), at.cross_edges(spark, sf), INTERACTION_PERMUTATIONS, seed=SEED))


@query("cooccurrence_test", f"""two_groups AS (SELECT DISTINCT sample_id, CASE WHEN sample_id < 4 THEN 'a' ELSE 'b' END AS grp FROM patches),
spots AS (SELECT sample_id, grp, row_number() OVER (ORDER BY sample_id) AS pos FROM two_groups),
drawn AS (SELECT sample_id, perm, row_number() OVER (PARTITION BY perm ORDER BY md5(concat_ws('|', '{SEED}', 0, perm, sample_id)), sample_id) AS r FROM two_groups, (SELECT unnest(range(1, {PERMUTATIONS + 1})) AS perm) q),
dealt AS (SELECT d.perm, d.sample_id, s.grp FROM drawn d JOIN spots s ON s.pos = d.r UNION ALL SELECT 0, sample_id, grp FROM two_groups),
own AS (SELECT * FROM patches WHERE ecm_cluster BETWEEN 0 AND {CLUSTERS - 1}),
pairs AS (SELECT e.sample_id, least(a.ecm_cluster, b.ecm_cluster) AS i, greatest(a.ecm_cluster, b.ecm_cluster) AS j, count(*) AS n FROM grid_edges e JOIN own a ON a.patch_id = e.src JOIN own b ON b.patch_id = e.dst GROUP BY 1, 2, 3),
seen AS (SELECT perm, grp, i, j, sum(n) AS n FROM dealt JOIN pairs USING (sample_id) GROUP BY 1, 2, 3, 4),
total AS (SELECT perm, grp, sum(CASE WHEN i = j THEN n ELSE 2 * n END) AS total FROM seen GROUP BY 1, 2),
share AS (SELECT perm, grp, i, count(*) / sum(count(*)) OVER (PARTITION BY perm, grp)::DOUBLE AS p FROM (SELECT perm, grp, ecm_cluster AS i FROM dealt JOIN own USING (sample_id)) q GROUP BY 1, 2, 3),
grid AS (SELECT perm, grp, i, j FROM (SELECT DISTINCT perm, grp FROM dealt) d, (SELECT unnest(range({CLUSTERS})) AS i) a, (SELECT unnest(range({CLUSTERS})) AS j) b WHERE i <= j),
valued AS (SELECT g.perm, g.grp, g.i, g.j, CASE WHEN t.total * a.p * b.p > 0 THEN log2((coalesce(s.n, 0) + 1e-9) / (t.total * a.p * b.p)) ELSE 0.0 END AS v FROM grid g
  LEFT JOIN seen s ON s.perm = g.perm AND s.grp = g.grp AND s.i = g.i AND s.j = g.j LEFT JOIN total t ON t.perm = g.perm AND t.grp = g.grp
  LEFT JOIN share a ON a.perm = g.perm AND a.grp = g.grp AND a.i = g.i LEFT JOIN share b ON b.perm = g.perm AND b.grp = g.grp AND b.i = g.j),
delta AS (SELECT perm, i, j, round(sum(CASE WHEN grp = 'a' THEN v ELSE -v END), 9) AS delta FROM valued GROUP BY 1, 2, 3),
tested AS (SELECT r.i, r.j, r.delta, (sum((abs(n.delta) >= abs(r.delta))::INT) + 1) / {PERMUTATIONS + 1}.0::DOUBLE AS p FROM delta r JOIN delta n ON n.i = r.i AND n.j = r.j AND n.perm > 0 WHERE r.perm = 0 GROUP BY ALL),
{FDR_SQL}
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(delta, 6) AS delta, round(p, 6) AS p, round(p_fdr, 6) AS p_fdr FROM adjusted""", P, LATTICE_SQL)
def _(spark, sf):
    # Two groups of the patches' samples.
    groups = labels(spark, sf).select("sample_id").distinct().withColumn("grp", F.when(F.col("sample_id") < 4, "a").otherwise("b"))
    return rounded(stats.cooccurrence_test(labels(spark, sf), lattice(spark, sf), groups, "a", "b", CLUSTERS, PERMUTATIONS, SEED))


@query("bh_adjust", """tested AS (SELECT c_custkey AS id, (c_custkey * 7919 % 1000 + 1) / 1000.0::DOUBLE AS p FROM customer),
ranked AS (SELECT *, max(r0) OVER (PARTITION BY p) AS r, count(*) OVER () AS k FROM (SELECT *, row_number() OVER (ORDER BY p) AS r0 FROM tested) q)
SELECT id, p, round(least(1.0, min(p * k / r) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_fdr FROM ranked""", C)
def _(spark, sf):
    p = at.cells(spark, sf).select(F.col("cell_id").alias("id"), ((F.col("cell_id") * 7919 % 1000 + 1) / 1000.0).alias("p"))
    return rounded(scale.benjamini_hochberg_ranged(p, "p"))


@query("centroid_table", f"""own AS (SELECT ecm_cluster AS cluster, unnest(['f0', 'f1']) AS marker, unnest([f0, f1]) AS v FROM patches WHERE ecm_cluster BETWEEN 0 AND {CLUSTERS - 1}),
means AS (SELECT cluster, marker, avg(v) AS mean, count(*) AS n FROM own GROUP BY 1, 2)
SELECT CAST(cluster AS INTEGER) AS cluster, marker, round(mean, 6) AS mean, n, round((mean - avg(mean) OVER (PARTITION BY marker)) / (stddev_pop(mean) OVER (PARTITION BY marker) + 1e-9), 6) AS z FROM means""", P)
def _(spark, sf):
    return rounded(stats.centroids(at.patches(spark, sf), ["f0", "f1"], CLUSTERS))


@query("niche_table", """met AS (SELECT greatest(f0, 0) AS f0, greatest(f1, 0) AS f1 FROM cross_edges JOIN cells ON cell_id = src JOIN patches ON patch_id = dst WHERE cell_type = 'BUILDING' AND ecm_cluster = 1),
means AS (SELECT 'f0' AS marker, avg(f0) AS mean FROM met UNION ALL SELECT 'f1', avg(f1) FROM met)
SELECT marker, round(mean, 6) AS mean, round(mean / sum(mean) OVER (), 6) AS share FROM means""", C, P, X)
def _(spark, sf):
    return rounded(stats.niche(at.cells(spark, sf), at.patches(spark, sf), at.cross_edges(spark, sf), "BUILDING", 1, ["f0", "f1"]))


@query("grouped_metric_summary", """SELECT cell_type, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(v) AS n FROM (
  SELECT cell_type, unnest(['marker', 'x']) AS metric, unnest([CASE WHEN cell_id % 5 <> 0 THEN marker END, x]) AS v FROM cells) q GROUP BY cell_type, metric""", C)
def _(spark, sf):
    rows = at.cells(spark, sf).select("cell_type", F.when(F.col("cell_id") % 5 != 0, F.col("marker")).alias("marker"), "x")
    return rounded(stats.grouped_summary(rows, "cell_type", ["marker", "x"]))


def _scores(spark, sf):
    own = at.cells(spark, sf).groupBy("sample_id").agg(F.max("marker").alias("score"))
    return at.samples(spark, sf).join(own, "sample_id", "left").select("grp", "sample_id", F.when(F.col("sample_id") % 6 != 0, F.col("score")).alias("score"))


SCORES_SQL = "scores AS (SELECT grp, s.sample_id, coalesce(CASE WHEN s.sample_id % 6 <> 0 THEN max(marker) END, 0.0) AS score FROM samples s LEFT JOIN cells c ON c.sample_id = s.sample_id GROUP BY 1, 2)"
for _selector, _pick in {"median": "n // 2 + 1", "max": "n", "min": "1"}.items():

    @query(f"representative_{_selector}", f"""SELECT grp, sample_id, score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score, sample_id) AS r, count(*) OVER (PARTITION BY grp) AS n FROM scores) q WHERE r = {_pick}""", S, C, SCORES_SQL)
    def _(spark, sf, selector=_selector):
        return stats.representatives(_scores(spark, sf), selector)


@query("partition_scores", """pairs AS (SELECT label, ecm AS truth FROM (SELECT label % 4 AS label, vec_id % 3 AS ecm FROM embeddings) q),
tab AS (SELECT label, truth, count(*) AS n FROM pairs GROUP BY 1, 2),
mapped AS (SELECT label, truth AS mapped FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, truth) AS r FROM tab) q WHERE r = 1),
cells AS (SELECT mapped, truth, sum(n) AS n FROM tab JOIN mapped USING (label) GROUP BY 1, 2),
c1 AS (SELECT mapped AS c, sum(n) AS called FROM cells GROUP BY 1), c2 AS (SELECT truth AS c, sum(n) AS true_ FROM cells GROUP BY 1), hit AS (SELECT truth AS c, n AS tp FROM cells WHERE mapped = truth),
f AS (SELECT avg(2.0 * coalesce(tp, 0) / (coalesce(called, 0) + coalesce(true_, 0))) AS macro_f1 FROM c2 FULL JOIN c1 USING (c) LEFT JOIN hit USING (c)),
a AS (SELECT sum(n * (n - 1) / 2.0) AS a FROM (SELECT sum(n) AS n FROM tab GROUP BY label) q), b AS (SELECT sum(n * (n - 1) / 2.0) AS b FROM (SELECT sum(n) AS n FROM tab GROUP BY truth) q),
w AS (SELECT sum(n * (n - 1) / 2.0) AS ab, sum(n) AS n FROM tab)
SELECT round(macro_f1, 6) AS macro_f1, round((ab - a * b / (n * (n - 1) / 2.0)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2.0)), 6) AS ari FROM f, a, b, w""", PT)
def _(spark, sf):
    return rounded(stats.partition_scores(at.table(spark, sf, "embeddings").select((F.col("label") % 4).alias("label"), (F.col("vec_id") % 3).alias("truth"))))


POINTS_OF_CURVES = """ties AS (SELECT sample_id, score, sum(label) AS t, count(*) AS c FROM truth GROUP BY 1, 2),
pts AS (SELECT sample_id, score, sum(t) OVER w AS tp, sum(c - t) OVER w AS fp, sum(t) OVER a AS p, sum(c - t) OVER a AS n FROM ties
  WINDOW w AS (PARTITION BY sample_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY sample_id))"""


@query("roc_points", "SELECT sample_id, score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(p AS BIGINT) AS p, CAST(n AS BIGINT) AS n FROM pts", T, POINTS_OF_CURVES)
def _(spark, sf):
    return stats.curve_points(at.truth(spark, sf))


@query("roc_auc", """steps AS (SELECT *, coalesce(lag(tp) OVER w, 0) AS tp0, coalesce(lag(fp) OVER w, 0) AS fp0 FROM pts WINDOW w AS (PARTITION BY sample_id ORDER BY score DESC))
SELECT sample_id, round(CASE WHEN first(p) > 0 AND first(n) > 0 THEN sum((fp - fp0) * (tp + tp0) / 2.0) / (first(p) * first(n)) END, 6) AS roc_auc,
  round(CASE WHEN first(p) > 0 AND first(n) > 0 THEN sum((tp - tp0) * tp / (tp + fp)::DOUBLE) / first(p) END, 6) AS average_precision FROM steps GROUP BY sample_id""", T, POINTS_OF_CURVES)
def _(spark, sf):
    return rounded(stats.curve_areas(at.truth(spark, sf)))


@query("roc_mean_curve", """curve AS (SELECT sample_id, fp / n::DOUBLE AS x, max(tp / p::DOUBLE) AS y FROM pts WHERE p > 0 AND n > 0 GROUP BY 1, 2),
grid AS (SELECT sample_id, i / 200.0::DOUBLE AS x FROM (SELECT DISTINCT sample_id FROM curve) s, (SELECT unnest(range(201)) AS i) q),
low AS (SELECT g.sample_id, g.x, c.x AS x0, c.y AS y0 FROM grid g ASOF LEFT JOIN curve c ON c.sample_id = g.sample_id AND g.x >= c.x),
high AS (SELECT g.sample_id, g.x, c.x AS x1, c.y AS y1 FROM grid g ASOF LEFT JOIN curve c ON c.sample_id = g.sample_id AND g.x <= c.x)
SELECT round(x, 6) AS x, round(avg(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END), 6) AS y FROM low JOIN high USING (sample_id, x) GROUP BY x""", T, POINTS_OF_CURVES)
def _(spark, sf):
    points = stats.curve_points(at.truth(spark, sf)).where("p > 0 and n > 0")
    return rounded(stats.mean_curve(points.select("sample_id", (F.col("fp") / F.col("n")).alias("x"), (F.col("tp") / F.col("p")).alias("y"))))


@query("pristine_flag_rate", """cut AS (SELECT sample_id, quantile_cont(score, 0.1) AS threshold FROM truth WHERE label = 1 GROUP BY 1)
SELECT sample_id, round(coalesce(threshold, 'inf'::DOUBLE), 6) AS threshold, round(avg(CASE WHEN label = 0 THEN (score >= coalesce(threshold, 'inf'::DOUBLE))::INT END), 6) AS flagged FROM truth LEFT JOIN cut USING (sample_id) GROUP BY 1, 2""", T)
def _(spark, sf):
    return rounded(stats.flag_rate(at.truth(spark, sf), 0.9))


@query("group_folds", """SELECT label, grp, CAST((row_number() OVER (PARTITION BY label ORDER BY grp) - 1) % 2 AS INTEGER) AS fold FROM (SELECT DISTINCT toxic AS label, source AS grp FROM labels JOIN documents USING (doc_id)) q""", T)
def _(spark, sf):
    return stats.group_folds(at.truth(spark, sf).select("label", F.col("sample_id").alias("grp")))


@query("class_probabilities", """own AS (SELECT s.grp AS unit, c.sample_id AS graph, cell_type AS cluster, (cell_id % 100) / 100.0::DOUBLE AS p FROM cells c JOIN samples s ON s.sample_id = c.sample_id),
g AS (SELECT unit, graph, cluster, avg(p) AS p, count(*) AS m FROM own GROUP BY 1, 2, 3)
SELECT unit, cluster, round(avg(p), 6) AS mean, round(coalesce(stddev_samp(p), 0), 6) AS sd, count(*) AS n_graphs, CAST(sum(m) AS BIGINT) AS n_nodes FROM g GROUP BY 1, 2""", C, S)
def _(spark, sf):
    rows = at.cells(spark, sf).join(at.samples(spark, sf), "sample_id").select(F.col("grp").alias("unit"), F.col("sample_id").alias("graph"), F.col("cell_type").alias("cluster"), (F.col("cell_id") % 100 / 100.0).alias("p"))
    return rounded(stats.class_probabilities(rows))


RECON_SQL = "recon AS (SELECT sample_id, ecm_cluster AS pristine, CASE WHEN patch_id % 9 = 0 THEN (ecm_cluster + 2) % 5 ELSE ecm_cluster END AS corrupted, CASE WHEN patch_id % 18 = 0 OR patch_id % 31 = 0 THEN ecm_cluster ELSE CASE WHEN patch_id % 9 = 0 THEN (ecm_cluster + 2) % 5 ELSE ecm_cluster END END AS denoised, patch_id % 9 = 0 AS art FROM patches)"


@query("reconstruction_scores", """SELECT sample_id, round(avg((corrupted = pristine)::INT), 6) AS accuracy_before, round(avg((denoised = pristine)::INT), 6) AS accuracy_after,
  round(avg(CASE WHEN art THEN (denoised = pristine)::INT END), 6) AS recovery, round(avg(CASE WHEN denoised <> corrupted THEN (denoised = pristine)::INT END), 6) AS precision,
  round(avg(CASE WHEN NOT art THEN (denoised <> corrupted)::INT END), 6) AS pristine_relabelled FROM recon GROUP BY sample_id""", P, RECON_SQL)
def _(spark, sf):
    art = F.col("patch_id") % 9 == 0
    bad = F.when(art, (F.col("ecm_cluster") + 2) % 5).otherwise(F.col("ecm_cluster"))
    fixed = (F.col("patch_id") % 18 == 0) | (F.col("patch_id") % 31 == 0)
    rows = at.patches(spark, sf).select("sample_id", F.col("ecm_cluster").alias("pristine"), bad.alias("corrupted"), F.when(fixed, F.col("ecm_cluster")).otherwise(bad).alias("denoised"), art.alias("is_artifact"))
    return rounded(stats.reconstruction(rows))


# Normalisation.


@query("min_max_normalise", """SELECT sample_id, cell_id, round(CASE WHEN max(marker) OVER w > min(marker) OVER w THEN (marker - min(marker) OVER w) / (max(marker) OVER w - min(marker) OVER w) ELSE 0.0 END, 6) AS v FROM cells WINDOW w AS (PARTITION BY sample_id)""", C)
def _(spark, sf):
    return rounded(at.cells(spark, sf).select("sample_id", "cell_id", scale.min_max("marker", "sample_id").alias("v")))


@query("z_normalise", """SELECT sample_id, cell_id, round((marker - avg(marker) OVER w) / CASE WHEN stddev_pop(marker) OVER w > 0 THEN stddev_pop(marker) OVER w ELSE 1 END, 6) AS v FROM cells WINDOW w AS (PARTITION BY sample_id)""", C)
def _(spark, sf):
    return rounded(at.cells(spark, sf).select("sample_id", "cell_id", scale.z_score("marker", "sample_id").alias("v")))


@query("arcsinh_clip_normalise", """top AS (SELECT sample_id, quantile_cont(asinh(marker / 5.0::DOUBLE), 0.995) AS t FROM cells GROUP BY 1)
SELECT c.sample_id, cell_id, round(least(greatest(CASE WHEN t > 0 THEN asinh(marker / 5.0::DOUBLE) / t ELSE asinh(marker / 5.0::DOUBLE) END, 0.0), 1.0), 6) AS v FROM cells c JOIN top USING (sample_id)""", C)
def _(spark, sf):
    return rounded(at.cells(spark, sf).select("sample_id", "cell_id", scale.arcsinh_clip("marker", "sample_id", cofactor=5.0).alias("v")))


# Pixels and patches.


@query("patch_mean_std_max", """SELECT sample_id, channel, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(max(v), 6) AS max, round(avg((v > mu)::INT), 6) AS signal_fraction FROM (
  SELECT *, avg(v) OVER (PARTITION BY sample_id, channel, "by", bx) AS mu FROM blocks) q GROUP BY 1, 2, 3, 4""", PX, BLOCKS_SQL)
def _(spark, sf):
    return rounded(patches.block_moments(block_rows(spark, sf)))


@query("patch_entropy", """lim AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM blocks WINDOW w AS (PARTITION BY sample_id, channel, "by", bx)),
bins AS (SELECT sample_id, channel, "by", bx, CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 32), 31) ELSE 0 END AS bin, count(*) AS n FROM lim GROUP BY 1, 2, 3, 4, 5),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY sample_id, channel, "by", bx)::DOUBLE AS p FROM bins)
SELECT sample_id, channel, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, round(-sum(p * ln(p + 1e-10)), 6) AS entropy FROM shares GROUP BY 1, 2, 3, 4""", PX, BLOCKS_SQL)
def _(spark, sf):
    return rounded(patches.block_entropy(block_rows(spark, sf)))


@query("patch_gradients", """g AS (SELECT *, CASE WHEN l IS NULL AND r IS NULL THEN 0 WHEN l IS NULL THEN r - v WHEN r IS NULL THEN v - l ELSE (r - l) / 2 END AS gx,
  CASE WHEN u IS NULL AND d IS NULL THEN 0 WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END AS gy FROM (
  SELECT *, lag(v) OVER a AS l, lead(v) OVER a AS r, lag(v) OVER b AS u, lead(v) OVER b AS d FROM blocks
  WINDOW a AS (PARTITION BY sample_id, channel, "by", bx, py ORDER BY px), b AS (PARTITION BY sample_id, channel, "by", bx, px ORDER BY py)) q),
t AS (SELECT sample_id, channel, "by", bx, avg(sqrt(gx*gx + gy*gy)) AS m, avg(gx*gx) AS xx, avg(gy*gy) AS yy, avg(gx*gy) AS xy FROM g GROUP BY 1, 2, 3, 4)
SELECT sample_id, channel, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, round(m, 6) AS gradient_magnitude, round(sqrt((xx-yy)*(xx-yy) + 4*xy*xy) / (xx + yy + 1e-10), 6) AS coherence FROM t""", PX, BLOCKS_SQL)
def _(spark, sf):
    return rounded(patches.block_gradients(block_rows(spark, sf)))


@query("patch_texture", """lev AS (SELECT *, CASE WHEN hi - lo >= 1e-8 THEN CAST(trunc((v - lo) / (hi - lo) * 15) AS INTEGER) ELSE 0 END AS level FROM (
  SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM blocks WINDOW w AS (PARTITION BY sample_id, channel, "by", bx)) q),
pairs AS (SELECT a.sample_id, a.channel, a."by", a.bx, s.angle, a.level AS i, b.level AS j FROM lev a CROSS JOIN (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1)) s(angle, dy, dx)
  JOIN lev b ON b.sample_id = a.sample_id AND b.channel = a.channel AND b."by" = a."by" AND b.bx = a.bx AND b.py = a.py + s.dy AND b.px = a.px + s.dx),
two AS (SELECT sample_id, channel, "by", bx, angle, i, j, count(*) AS n FROM (SELECT * FROM pairs UNION ALL SELECT sample_id, channel, "by", bx, angle, j, i FROM pairs) q GROUP BY ALL),
pr AS (SELECT *, n / sum(n) OVER (PARTITION BY sample_id, channel, "by", bx, angle)::DOUBLE AS p FROM two),
mu AS (SELECT *, sum(p * i) OVER (PARTITION BY sample_id, channel, "by", bx, angle) AS m FROM pr),
an AS (SELECT sample_id, channel, "by", bx, angle, sum(p * (i-j)*(i-j)) AS contrast, sum(p / (1 + (i-j)*(i-j))) AS homogeneity, sqrt(sum(p*p)) AS energy, sum(p*(i-m)*(j-m)) AS cov, sum(p*(i-m)*(i-m)) AS var FROM mu GROUP BY 1, 2, 3, 4, 5)
SELECT sample_id, channel, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, round(avg(contrast), 6) AS glcm_contrast, round(avg(homogeneity), 6) AS glcm_homogeneity, round(avg(energy), 6) AS glcm_energy,
  round(avg(CASE WHEN var < 1e-15 THEN 1.0 ELSE cov / var END), 6) AS glcm_correlation FROM an GROUP BY 1, 2, 3, 4""", PX, BLOCKS_SQL)
def _(spark, sf):
    return rounded(patches.block_texture(block_rows(spark, sf)))


@query("signal_patches", """m AS (SELECT sample_id, channel, "by", bx, avg(v) AS mean FROM blocks GROUP BY 1, 2, 3, 4)
SELECT sample_id, channel, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, round(mean, 6) AS mean FROM m WHERE mean > (SELECT quantile_cont(mean, 0.1) FROM m)""", PX, BLOCKS_SQL)
def _(spark, sf):
    return rounded(patches.signal_blocks(patches.block_moments(block_rows(spark, sf)).select(*patches.BLOCK, "mean")))


@query("two_means_threshold", """own AS (SELECT v, count(*) AS n FROM pixels WHERE v > 0 GROUP BY v),
run AS (SELECT v, CAST(sum(n) OVER w AS DOUBLE) AS n, sum(n * v) OVER w AS s FROM own WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT max(n) AS n1, arg_max(s, v) AS s1 FROM run),
split AS (SELECT v, s * s / n + CASE WHEN n1 > n THEN (s1 - s) * (s1 - s) / (n1 - n) ELSE 0 END AS gain, CASE WHEN n1 > n THEN (s / n + (s1 - s) / (n1 - n)) / 2 ELSE s / n END AS middle FROM run, whole)
SELECT round(coalesce((SELECT middle FROM split ORDER BY gain DESC, v LIMIT 1), 'inf'::DOUBLE), 6) AS threshold""", PX)
def _(spark, sf):
    return rounded(patches.two_means(at.pixels(spark, sf)))


@query("paint_labels", f"""SELECT sample_id, y, x, CASE WHEN (y // {BLOCK} + x // {BLOCK}) % 3 = 0 THEN -1 ELSE CAST((y // {BLOCK} * 7 + x // {BLOCK}) % 5 AS INTEGER) END AS label FROM pixels""", PX)
def _(spark, sf):
    b = at.pixels(spark, sf).select("sample_id", F.expr(f"cast(y div {BLOCK} as int)").alias("by"), F.expr(f"cast(x div {BLOCK} as int)").alias("bx")).distinct()
    own = b.where((F.col("by") + F.col("bx")) % 3 != 0).withColumn("label", (F.col("by") * 7 + F.col("bx")) % 5)
    return patches.paint(at.pixels(spark, sf), own, BLOCK)


DISK_SQL = "disk AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy) a, (SELECT unnest(range(-2, 3)) AS dx) b WHERE dy*dy + dx*dx <= 4)"


@query("top_hat", """er AS (SELECT a.sample_id, a.channel, a.y, a.x, min(b.v) AS v FROM pixels a, disk d JOIN pixels b ON b.sample_id = a.sample_id AND b.channel = a.channel AND b.y = a.y + d.dy AND b.x = a.x + d.dx GROUP BY 1, 2, 3, 4),
op AS (SELECT a.sample_id, a.channel, a.y, a.x, max(b.v) AS v FROM er a, disk d JOIN er b ON b.sample_id = a.sample_id AND b.channel = a.channel AND b.y = a.y + d.dy AND b.x = a.x + d.dx GROUP BY 1, 2, 3, 4)
SELECT p.sample_id, p.channel, p.y, p.x, round(p.v - o.v, 6) AS v FROM pixels p JOIN op o ON o.sample_id = p.sample_id AND o.channel = p.channel AND o.y = p.y AND o.x = p.x""", PX, DISK_SQL)
def _(spark, sf):
    return rounded(patches.top_hat(at.pixels(spark, sf), 2))


@query("cell_features_from_mask", f"""SELECT sample_id, CAST(y // {SIDE} * 100 + x // {SIDE} AS INTEGER) AS label, channel, round(avg(v), 6) AS mean, count(*) AS area, round(avg(y), 6) AS y, round(avg(x), 6) AS x FROM pixels WHERE y // {SIDE} * 100 + x // {SIDE} > 0 GROUP BY 1, 2, 3""", PX)
def _(spark, sf):
    mask = at.pixels(spark, sf).select("sample_id", "y", "x", F.expr(f"cast(y div {SIDE} * 100 + x div {SIDE} as int)").alias("label"))
    return rounded(patches.cell_means(mask, at.pixels(spark, sf)))


@query("cell_window_means", """own AS (SELECT 0 AS sample_id, cell_id, CAST(trunc(y / 10) AS INTEGER) AS cy, CAST(trunc(x / 10) AS INTEGER) AS cx FROM cells)
SELECT o.sample_id, o.cell_id, channel, round(avg(v), 6) AS mean FROM own o JOIN pixels p ON p.sample_id = o.sample_id AND p.y BETWEEN cy - 3 AND cy + 3 AND p.x BETWEEN cx - 3 AND cx + 3 GROUP BY 1, 2, 3""", C, PX)
def _(spark, sf):
    cells = at.cells(spark, sf).select(F.lit(0).alias("sample_id"), "cell_id", (F.col("y") / 10).alias("y"), (F.col("x") / 10).alias("x"))
    return rounded(patches.window_means(cells, at.pixels(spark, sf)))


@query("max_projection", "SELECT sample_id, y, x, round(max(v) / max(max(v)) OVER (PARTITION BY sample_id), 6) AS v FROM pixels GROUP BY sample_id, y, x", PX)
def _(spark, sf):
    top = at.pixels(spark, sf).groupBy("sample_id", "y", "x").agg(F.max("v").alias("v"))
    whole = top.groupBy("sample_id").agg(F.max("v").alias("_m"))
    return rounded(top.join(whole, "sample_id").select("sample_id", "y", "x", (F.col("v") / F.col("_m")).alias("v")))


@query("relabel_background", """st AS (SELECT ecm_cluster, avg(f0) AS m, count(*) AS n FROM patches GROUP BY 1),
dim AS (SELECT ecm_cluster FROM st ORDER BY m, ecm_cluster LIMIT 1),
rk AS (SELECT ecm_cluster, row_number() OVER (ORDER BY n DESC, ecm_cluster) - 1 AS label FROM st WHERE ecm_cluster <> (SELECT ecm_cluster FROM dim))
SELECT p.patch_id, CAST(coalesce(label, -1) AS INTEGER) AS label FROM patches p LEFT JOIN rk USING (ecm_cluster)""", P)
def _(spark, sf):
    return patches.relabel_background(at.patches(spark, sf), "f0").select("patch_id", "label")


def _overlaid(spark, sf):
    own = at.patches(spark, sf)
    overlay = own.where("patch_id % 9 = 0").select("patch_id", F.lit(True).alias("is_artifact"), ((F.col("ecm_cluster") + 2) % 5).alias("replacement"), F.col("ecm_cluster").alias("reference"))
    return patches.apply_overlay(own, overlay)


@query("overlay_summary", """SELECT sample_id, count(*) AS n_patches, CAST(sum((label >= 0)::INT) AS BIGINT) AS n_signal, CAST(sum(art::INT) AS BIGINT) AS n_artifacts, CAST(sum((label <> ecm_cluster)::INT) AS BIGINT) AS n_changed FROM (
  SELECT sample_id, ecm_cluster, patch_id % 9 = 0 AS art, CASE WHEN patch_id % 9 = 0 THEN (ecm_cluster + 2) % 5 ELSE ecm_cluster END AS label FROM patches) q GROUP BY sample_id""", P)
def _(spark, sf):
    return patches.overlay_summary(_overlaid(spark, sf))


@query("compare_patches", """SELECT sample_id, count(*) AS n, CAST(sum((patch_id % 10 <> 0)::INT) AS BIGINT) AS n_close, CAST(sum((patch_id % 4 <> 0)::INT) AS BIGINT) AS n_labels FROM patches GROUP BY sample_id""", P)
def _(spark, sf):
    own = at.patches(spark, sf)
    other = own.withColumns({"f0": F.col("f0") * F.when(F.col("patch_id") % 10 == 0, 1.001).otherwise(1 + 1e-7), "ecm_cluster": F.col("ecm_cluster") + F.when(F.col("patch_id") % 4 == 0, 1).otherwise(0)})
    return patches.compare(own, other, ["f0", "f1"])


@query("neighbour_shares", f"""SELECT sample_id, id, label, round(n / sum(n) OVER (PARTITION BY sample_id, id)::DOUBLE, 6) AS share FROM (
  SELECT b.sample_id, b.src AS id, p.ecm_cluster AS label, count(*) AS n FROM both_ways b JOIN patches p ON p.patch_id = b.dst WHERE p.ecm_cluster BETWEEN 0 AND {CLUSTERS - 1} GROUP BY 1, 2, 3) q""", P, LATTICE_SQL, BOTH_SQL)
def _(spark, sf):
    return rounded(patches.neighbour_shares(lattice(spark, sf), labels(spark, sf), CLUSTERS))


@query("prior_scores", """pr AS (SELECT ecm_cluster, -ln(count(*) / sum(count(*)) OVER ()::DOUBLE + 1e-9) AS s FROM patches WHERE ecm_cluster >= 0 AND sample_id <> 0 GROUP BY 1)
SELECT sample_id, patch_id AS id, p.ecm_cluster AS label, round(coalesce(s, 0.0), 6) AS score FROM patches p LEFT JOIN pr USING (ecm_cluster)""", P)
def _(spark, sf):
    own = labels(spark, sf)
    return rounded(patches.prior_scores(own.where("sample_id <> 0"), own))


@query("denoise_labels", """own AS (SELECT *, CAST((patch_id * 13 % 6) - 1 AS INTEGER) AS predicted, (patch_id * 29 % 100) / 100.0::DOUBLE AS anomaly FROM patches),
cand AS (SELECT * FROM own WHERE ecm_cluster >= 0 AND predicted >= 0 AND predicted <> ecm_cluster AND anomaly >= 0.3),
near AS (SELECT a.patch_id, count(*) AS n FROM cand a JOIN cand b ON a.sample_id = b.sample_id AND a.patch_id <> b.patch_id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 196 GROUP BY 1)
SELECT sample_id, o.patch_id AS id, CASE WHEN n >= 2 THEN predicted ELSE ecm_cluster END AS denoised FROM own o LEFT JOIN near USING (patch_id)""", P)
def _(spark, sf):
    own = at.patches(spark, sf).select("sample_id", F.col("patch_id").alias("id"), "x", "y", F.col("ecm_cluster").alias("label"), (F.col("patch_id") * 13 % 6 - 1).cast("int").alias("predicted"), (F.col("patch_id") * 29 % 100 / 100.0).alias("anomaly"))
    return patches.denoise(own).select("sample_id", "id", "denoised")


# Sources, sinks, geometry, thresholds, clusters and models.


@query("panel_summary", """SELECT count(*) AS n_channels, CAST(sum((p_size % 2 = 1)::INT) AS BIGINT) AS n_ecm FROM part WHERE p_size % 3 <> 0""", P)
def _(spark, sf):
    rows = at.table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias(" name "), (F.col("p_size") % 2).alias("ecm"), F.when(F.col("p_size") % 3 != 0, 1).otherwise(0).alias("keep"))
    return tables.panel_summary(tables.panel(rows)).drop("aligned")


@query("sample_groups", "SELECT * FROM samples WHERE grp <> 'ASIA'", S)
def _(spark, sf):
    own = at.samples(spark, sf)
    return tables.sample_groups(own.withColumn("grp", F.when(F.col("grp") != "ASIA", F.col("grp"))), "grp")


@query("input_summary", """SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, n_cells, n_types, n_untyped, n_channels, height, width, least, most FROM
  (SELECT sample_id, count(*) AS n_cells, count(DISTINCT cell_type) AS n_types, CAST(sum((cell_type IS NULL)::INT) AS BIGINT) AS n_untyped FROM cells GROUP BY 1) a FULL JOIN
  (SELECT sample_id, count(DISTINCT channel) AS n_channels, max(y) + 1 AS height, max(x) + 1 AS width, round(min(v), 6) AS least, round(max(v), 6) AS most FROM pixels GROUP BY 1) b ON a.sample_id = b.sample_id""", C, PX)
def _(spark, sf):
    return rounded(tables.input_summary(at.cells(spark, sf), at.pixels(spark, sf)))


@query("region_points", "SELECT sample_id AS region, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY patch_id) - 1 AS INTEGER) AS instance_id, x, y, ecm_cluster FROM patches", P)
def _(spark, sf):
    return sinks.region_points(at.patches(spark, sf))


@query("graph_export", """num AS (SELECT sample_id, patch_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY patch_id) - 1 AS INTEGER) AS node FROM patches)
SELECT b.sample_id, s.node AS source, t.node AS target FROM both_ways b JOIN num s ON s.patch_id = b.src JOIN num t ON t.patch_id = b.dst""", P, LATTICE_SQL, BOTH_SQL)
def _(spark, sf):
    nodes = at.patches(spark, sf).select("sample_id", F.col("patch_id").alias("id"))
    return sinks.graph_tables(nodes, lattice(spark, sf))[1].select("sample_id", "source", "target")


@query("crop", "SELECT sample_id, channel, y - 10 AS y, x - 90 AS x, round(v, 6) AS v FROM pixels WHERE y BETWEEN 10 AND 29 AND x BETWEEN 90 AND 109", PX)
def _(spark, sf):
    return rounded(images.crop(at.pixels(spark, sf), 90, 10, 20, 20))


@query("tiles_with_halo", """edge AS (SELECT sample_id, max(y) AS h, max(x) AS w FROM pixels GROUP BY 1),
t AS (SELECT DISTINCT p.sample_id, channel, y, x, v, CAST(floor((y + a.d) / 32.0) AS INTEGER) AS ty, CAST(floor((x + b.d) / 32.0) AS INTEGER) AS tx FROM pixels p, (VALUES (-4), (0), (4)) a(d), (VALUES (-4), (0), (4)) b(d))
SELECT t.sample_id, ty, tx, count(*) AS n, CAST(sum((y // 32 = ty AND x // 32 = tx)::INT) AS BIGINT) AS n_inner, round(sum(v), 6) AS total FROM t JOIN edge e USING (sample_id)
WHERE ty >= 0 AND tx >= 0 AND ty * 32 <= h AND tx * 32 <= w GROUP BY 1, 2, 3""", PX)
def _(spark, sf):
    rows = images.with_halo(at.pixels(spark, sf), 32, 4)
    return rounded(rows.groupBy("sample_id", "ty", "tx").agg(F.count("*").alias("n"), F.sum(F.col("inner").cast("int")).alias("n_inner"), F.sum("v").alias("total")))


#: An edge is in the triangulation if some circle through its ends and a third point holds no other; samples have three points or more here.
DELAUNAY_SQL = """tri AS (SELECT *, (bx * bx + "by" * "by") AS b2, (cx * cx + cy * cy) AS c2, 2 * (bx * cy - "by" * cx) AS w FROM (
  SELECT a.sample_id, a.id AS i, b.id AS j, c.id AS k, a.x AS ax, a.y AS ay, b.x - a.x AS bx, b.y - a.y AS "by", c.x - a.x AS cx, c.y - a.y AS cy
  FROM points a JOIN points b ON b.sample_id = a.sample_id AND b.id > a.id JOIN points c ON c.sample_id = b.sample_id AND c.id > b.id) q),
circles AS (SELECT sample_id, i, j, k, ax + (cy * b2 - "by" * c2) / w AS ux, ay + (bx * c2 - cx * b2) / w AS uy, ((cy * b2 - "by" * c2) / w) ** 2 + ((bx * c2 - cx * b2) / w) ** 2 AS r2 FROM tri WHERE w <> 0),
filled AS (SELECT DISTINCT t.sample_id, i, j, k FROM circles t JOIN points p ON p.sample_id = t.sample_id WHERE p.id <> i AND p.id <> j AND p.id <> k AND (p.x - ux) ** 2 + (p.y - uy) ** 2 < r2 * (1 - 1e-9)),
empty AS (SELECT sample_id, i, j, k FROM circles EXCEPT SELECT * FROM filled),
joined AS (SELECT sample_id, i AS src, j AS dst FROM empty UNION SELECT sample_id, j, k FROM empty UNION SELECT sample_id, i, k FROM empty),
delaunay AS (SELECT e.sample_id, src, dst, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d FROM joined e JOIN points a ON a.id = src JOIN points b ON b.id = dst)"""


@query("delaunay_edges", "SELECT sample_id, src, dst, round(d, 6) AS d FROM delaunay", PT, DELAUNAY_SQL)
def _(spark, sf):
    return rounded(geometry.delaunay_edges(at.points(spark, sf)))


@query("delaunay_bipartite", "SELECT sample_id, CASE WHEN src % 3 = 0 THEN src ELSE dst END AS src, CASE WHEN src % 3 = 0 THEN dst ELSE src END AS dst, round(d, 6) AS d FROM delaunay WHERE (src % 3 = 0) <> (dst % 3 = 0)", PT, DELAUNAY_SQL)
def _(spark, sf):
    p = at.points(spark, sf)
    return rounded(geometry.delaunay_bipartite(p.where("id % 3 = 0"), p.where("id % 3 <> 0")))


@query("central_voids")
def _(spark, sf):
    p = at.points(spark, sf)
    return rounded(geometry.central_voids(p.join(graph.components(p, spatial.radius_edges(p, RADIUS)), ["sample_id", "id"]), RADIUS))


def _parts(spark, sf):
    """Components of near points, and their edges."""
    p = at.points(spark, sf)
    edges = written(spatial.radius_edges(p, RADIUS), "near-points")
    return graph.components(p, edges), edges


@query("path_measures", """ends AS (SELECT sample_id, src AS id, dst AS other FROM radius_edges UNION ALL SELECT sample_id, dst, src FROM radius_edges),
steps AS (SELECT sample_id, id AS root, id, 0 AS depth FROM points UNION SELECT s.sample_id, s.root, e.other, depth + 1 FROM steps s JOIN ends e ON e.sample_id = s.sample_id AND e.id = s.id WHERE depth < 40),
apart AS (SELECT sample_id, root, id, min(depth) AS d FROM steps GROUP BY 1, 2, 3 HAVING root <> id),
per AS (SELECT a.sample_id, g.component, root, count(*) + 1 AS n, sum(d) AS total, max(d) AS most FROM apart a JOIN groups g ON g.sample_id = a.sample_id AND g.id = a.root GROUP BY 1, 2, 3)
SELECT sample_id, component, CAST(first(n) AS INTEGER) AS n_nodes, CASE WHEN first(n) > 3 THEN CAST(max(most) AS INTEGER) END AS diameter, CASE WHEN first(n) > 3 THEN round(sum(total) / (first(n) * (first(n) - 1))::DOUBLE, 6) END AS mean_path,
  CASE WHEN first(n) > 3 THEN round((sum(total) - first(n) * (first(n) - 1)) / (first(n) * (first(n) - 1) * (first(n) - 2))::DOUBLE, 6) END AS betweenness, CASE WHEN first(n) > 3 THEN round(avg((n - 1) / total::DOUBLE), 6) END AS closeness
FROM per GROUP BY sample_id, component""", PT, RADIUS_SQL, COMPONENTS_SQL)
def _(spark, sf):
    return rounded(geometry.path_lengths(*_parts(spark, sf)))


@query("connectivity")
def _(spark, sf):
    return rounded(geometry.fiedler_values(*_parts(spark, sf)))


#: Counts of the positive pixels in 256 bins of each channel, and their running sums.
HIST_SQL = """span AS (SELECT sample_id, channel, min(v) AS lo, max(v) AS hi FROM pixels WHERE v > 0 GROUP BY 1, 2 HAVING count(*) >= 10),
level AS (SELECT p.sample_id, p.channel, CASE WHEN hi > lo THEN least(CAST(floor((v - lo) / (hi - lo) * 256) AS BIGINT), 255) ELSE 0 END AS bin, count(*) AS n FROM pixels p JOIN span s ON s.sample_id = p.sample_id AND s.channel = p.channel WHERE v > 0 GROUP BY 1, 2, 3),
hist AS (SELECT s.sample_id, s.channel, lo, hi, b.bin, lo + (b.bin + 0.5::DOUBLE) * (hi - lo) / 256 AS c, CAST(coalesce(l.n, 0) AS DOUBLE) AS n FROM span s CROSS JOIN (SELECT unnest(range(256)) AS bin) b
  LEFT JOIN level l ON l.sample_id = s.sample_id AND l.channel = s.channel AND l.bin = b.bin),
sums AS (SELECT *, sum(n) OVER up AS w, sum(n * c) OVER up AS m, sum(n * n) OVER up AS q, sum(n) OVER whole AS w1, sum(n * c) OVER whole AS m1, sum(n * n) OVER whole AS q1 FROM hist
  WINDOW up AS (PARTITION BY sample_id, channel ORDER BY bin ROWS UNBOUNDED PRECEDING), whole AS (PARTITION BY sample_id, channel))"""


def _best_split_sql(score: str) -> str:
    """cut(sample_id, channel, threshold): the first bin of the largest score, which differs by rounding errors where bins are empty."""
    return f"""scored AS (SELECT *, {score} AS score FROM sums WHERE bin < 255),
cut AS (SELECT sample_id, channel, CASE WHEN hi > lo THEN c ELSE lo END AS threshold FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id, channel ORDER BY round(score / top, 11) DESC NULLS LAST, bin) AS r FROM (SELECT *, max(abs(score)) OVER (PARTITION BY sample_id, channel) AS top FROM scored) q) q WHERE r = 1)"""


THRESHOLD_SQL = {
    "otsu": _best_split_sql("CASE WHEN w > 0 AND w1 > w THEN w * (w1 - w) * (m / w - (m1 - m) / (w1 - w)) ** 2 END"),
    "yen": _best_split_sql("CASE WHEN w > 0 AND w1 > w AND q > 0 AND q1 > q THEN ln((w / w1 * (1 - w / w1)) ** 2 / (q / w1 / w1 * ((q1 - q) / w1 / w1))) END"),
    "triangle": """peaks AS (SELECT sample_id, channel, min(bin) FILTER (WHERE n = top) AS peak, min(bin) FILTER (WHERE n > 0) AS low, max(bin) FILTER (WHERE n > 0) AS high FROM (SELECT *, max(n) OVER (PARTITION BY sample_id, channel) AS top FROM hist) q GROUP BY 1, 2),
ends AS (SELECT *, CASE WHEN peak - low > high - peak THEN low ELSE high END AS last FROM peaks),
gaps AS (SELECT h.*, abs(h.bin - e.peak) AS far, p.n + (l.n - p.n) * abs(h.bin - e.peak) / greatest(abs(e.last - e.peak), 1) - h.n AS gap FROM hist h JOIN ends e ON e.sample_id = h.sample_id AND e.channel = h.channel
  JOIN hist p ON p.sample_id = e.sample_id AND p.channel = e.channel AND p.bin = e.peak JOIN hist l ON l.sample_id = e.sample_id AND l.channel = e.channel AND l.bin = e.last WHERE h.bin BETWEEN least(e.peak, e.last) AND greatest(e.peak, e.last)),
cut AS (SELECT sample_id, channel, CASE WHEN hi > lo THEN c ELSE lo END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, channel ORDER BY round(gap, 9) DESC, far) AS r FROM gaps) q WHERE r = 1)""",
    "li": """moved AS (SELECT h.*, least(0.0, f.c - 1e-9) - 1e-9 AS shift, h.c - (least(0.0, f.c - 1e-9) - 1e-9) AS v FROM hist h JOIN hist f ON f.sample_id = h.sample_id AND f.channel = h.channel AND f.bin = 0),
steps AS (SELECT 0 AS step, sample_id, channel, sum(v * n) / sum(n) AS t, 'inf'::DOUBLE AS was FROM moved GROUP BY 2, 3
  UNION ALL SELECT step + 1, sample_id, channel, CASE WHEN a IS NULL OR b IS NULL THEN t WHEN a <> b THEN (a - b) / (ln(a) - ln(b)) ELSE a END, t FROM (
    SELECT s.step, s.sample_id, s.channel, s.t, sum(v * n) FILTER (WHERE v <= t) / nullif(sum(n) FILTER (WHERE v <= t), 0) AS a, sum(v * n) FILTER (WHERE v > t) / nullif(sum(n) FILTER (WHERE v > t), 0) AS b
    FROM steps s JOIN moved m ON m.sample_id = s.sample_id AND m.channel = s.channel WHERE abs(s.t - s.was) >= 1e-9 AND step < 1000 GROUP BY 1, 2, 3, 4) q),
cut AS (SELECT sample_id, channel, CASE WHEN hi > lo THEN was + shift ELSE lo END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, channel ORDER BY step DESC) AS r FROM steps) s JOIN moved m USING (sample_id, channel) WHERE r = 1 AND bin = 0)""",
}
for _method in thresholds.METHODS:

    @query(f"threshold_{_method}", f"{THRESHOLD_SQL[_method]} SELECT sample_id, channel, round(threshold, 6) AS threshold FROM cut", PX, HIST_SQL)
    def _(spark, sf, method=_method):
        return rounded(thresholds.thresholds(at.pixels(spark, sf), method))


@query("adaptive_signal", f"""{THRESHOLD_SQL["otsu"]} SELECT DISTINCT sample_id, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx FROM (
  SELECT b.sample_id, b.channel, "by", bx, avg((v > threshold)::INT) AS s FROM blocks b JOIN cut c ON c.sample_id = b.sample_id AND c.channel = b.channel GROUP BY 1, 2, 3, 4) q WHERE s > 0.1""", PX, BLOCKS_SQL, HIST_SQL)
def _(spark, sf):
    return thresholds.adaptive_signal(block_rows(spark, sf), thresholds.thresholds(at.pixels(spark, sf), "otsu"))


@query("skeleton_features")
def _(spark, sf):
    return rounded(skeleton.block_skeletons(block_rows(spark, sf), BLOCK))


@query("kmeans_patches")
def _(spark, sf):
    return cluster.kmeans(at.patches(spark, sf), ["f0", "f1"], CLUSTERS).select("sample_id", "patch_id", "cluster")


@query("cluster_quality", """moments AS (SELECT avg(f0) AS m0, stddev_pop(f0) AS s0, avg(f1) AS m1, stddev_pop(f1) AS s1 FROM patches),
scaled AS (SELECT patch_id, ecm_cluster AS c, CASE WHEN s0 > 0 THEN (f0 - m0) / s0 ELSE 0 END AS z0, CASE WHEN s1 > 0 THEN (f1 - m1) / s1 ELSE 0 END AS z1 FROM patches, moments),
apart AS (SELECT a.patch_id, a.c, b.c AS o, avg(sqrt((a.z0-b.z0)*(a.z0-b.z0) + (a.z1-b.z1)*(a.z1-b.z1))) AS d FROM scaled a JOIN scaled b ON a.patch_id <> b.patch_id GROUP BY 1, 2, 3),
sides AS (SELECT patch_id, min(d) FILTER (WHERE o <> c) AS b, max(d) FILTER (WHERE o = c) AS a FROM apart GROUP BY 1),
parts AS (SELECT c, k, count(*) AS n, sum(v) AS s, sum(v * v) AS q, sum(sum(v)) OVER (PARTITION BY k) / sum(count(*)) OVER (PARTITION BY k) AS m FROM (SELECT c, unnest([0, 1]) AS k, unnest([z0, z1]) AS v FROM scaled) q GROUP BY 1, 2),
spread AS (SELECT sum(n * (s / n - m) ** 2) AS b, sum(q - s * s / n) AS w, count(DISTINCT c) AS c, sum(n) / 2 AS n FROM parts)
SELECT round((SELECT avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) FROM sides), 6) AS silhouette, round((b / (c - 1)) / (w / (n - c)), 6) AS calinski_harabasz FROM spread""", P)
def _(spark, sf):
    own = cluster.standardised(at.patches(spark, sf), ["f0", "f1"]).withColumnRenamed("ecm_cluster", "cluster")
    return rounded(cluster.silhouette(own, "patch_id").crossJoin(cluster.calinski_harabasz(own)))


@query("neighbourhood_clusters")
def _(spark, sf):
    cells = at.cells(spark, sf).select("sample_id", F.col("cell_id").alias("id"), "cell_type", "x", "y")
    return cluster.neighbourhoods(cells, spatial.knn_edges(cells, NEAREST)).select("sample_id", "id", "cluster")


def _folds(spark, sf):
    return at.patches(spark, sf).select("sample_id").distinct().withColumn("fold", (F.col("sample_id") % 2).cast("string"))


def _corrupted(spark, sf):
    art = F.col("patch_id") % 9 == 0
    label = F.when(art & (F.col("ecm_cluster") >= 0), (F.col("ecm_cluster") + 2) % CLUSTERS).otherwise(F.col("ecm_cluster"))
    return at.patches(spark, sf).select("sample_id", F.col("patch_id").alias("id"), label.alias("label"), art.alias("truth"))


def _builder(spark, sf, context):
    cells = at.cells(spark, sf).select("sample_id", "cell_id", "cell_type")
    types = sorted(r[0] for r in cells.select("cell_type").distinct().collect())
    return lambda rows: denoise.features(rows, cells, at.cross_edges(spark, sf), lattice(spark, sf), types, CLUSTERS, context)


@query("held_out_scores")
def _(spark, sf):
    return rounded(denoise.areas(denoise.held_out(labels(spark, sf), _corrupted(spark, sf), _builder(spark, sf, "joint"), _folds(spark, sf))))


@query("context_ablation")
def _(spark, sf):
    builders = {c: _builder(spark, sf, c) for c in ("cell", "ecm", "joint")}
    return rounded(denoise.summary(denoise.ablation(labels(spark, sf), _corrupted(spark, sf), builders, _folds(spark, sf))))


@query("annotate_structures", f"""top AS (SELECT cluster FROM (SELECT id % 4 AS cluster, avg(value) AS m FROM points GROUP BY 1) q ORDER BY m DESC, cluster LIMIT 2),
picked AS (SELECT sample_id, id, x, y FROM points WHERE id % 4 IN (SELECT cluster FROM top)),
near AS (SELECT a.sample_id, a.id AS one, b.id AS other FROM picked a JOIN picked b ON a.sample_id = b.sample_id AND a.id <> b.id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= {RADIUS * RADIUS}),
walk AS (SELECT sample_id, id, id AS root FROM picked UNION SELECT n.sample_id, n.other, w.root FROM walk w JOIN near n ON n.sample_id = w.sample_id AND n.one = w.id),
sizes AS (SELECT sample_id, id, count(*) OVER (PARTITION BY sample_id, component) AS n FROM (SELECT sample_id, id, min(root) AS component FROM walk GROUP BY 1, 2) q)
SELECT p.sample_id, p.id, coalesce(n >= 3, false) AS structure FROM points p LEFT JOIN sizes s ON s.sample_id = p.sample_id AND s.id = p.id""", PT)
def _(spark, sf):
    p = at.points(spark, sf).withColumn("cluster", F.col("id") % 4)
    return structures.annotate(p, ["VAL"], 2, RADIUS, 3).select("sample_id", "id", "structure")


@query("split_structures", """big AS (SELECT sample_id, component, row_number() OVER (PARTITION BY sample_id ORDER BY component) - 1 AS i FROM groups GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT p.sample_id, p.id, round(p.x, 6) AS x, round(p.y, 6) AS y, CASE WHEN b.i IS NOT NULL THEN printf('%d_islet%02d', p.sample_id, b.i) END AS uid
FROM points p JOIN groups g ON g.sample_id = p.sample_id AND g.id = p.id LEFT JOIN big b ON b.sample_id = g.sample_id AND b.component = g.component""", PT, RADIUS_SQL, COMPONENTS_SQL)
def _(spark, sf):
    return rounded(structures.split(at.points(spark, sf).select("sample_id", "id", "x", "y"), "islet", RADIUS, 3))


@query("structure_shapes")
def _(spark, sf):
    p = at.points(spark, sf)
    own = structures.split(p.select("sample_id", "id", "x", "y"), "islet", RADIUS, 3).join(p.select("id", (F.col("value") > 0).cast("int").alias("flag")), "id")
    return rounded(structures.shape_features(own))


@query("structure_features")
def _(spark, sf):
    # Signal patches of a sample make a structure; its mask is their cover, and every third is around it.
    own = at.patches(spark, sf).where("ecm_cluster >= 0").withColumn("uid", F.concat(F.lit("s"), F.col("sample_id").cast("string")))
    around = own.select("sample_id", "uid", F.col("patch_id").alias("id"), F.col("y").alias("row"), F.col("x").alias("col"), (F.col("patch_id") % 3 == 0).alias("is_peri"), F.col("f1").alias("value"))
    return rounded(structures.structure_features(own.select("sample_id", "uid", F.col("grid_y").alias("y"), F.col("grid_x").alias("x")), around))


@query("graph_communities")
def _(spark, sf):
    return communities.communities(lattice(spark, sf))


@query("ridge_filter")
def _(spark, sf):
    return rounded(filters.ridge_filter(at.pixels(spark, sf), (1, 2)))


@query("segment_threshold")
def _(spark, sf):
    return filters.segment(at.pixels(spark, sf), "triangle", 3)


def _graphs(spark, sf):
    """One-hot cluster graphs of the patches' samples, signal only, in two classes of samples."""
    own = at.patches(spark, sf).where("ecm_cluster >= 0")
    nodes = own.select(F.col("sample_id").cast("long").alias("graph"), F.col("patch_id").alias("node"), (F.col("sample_id") % 2).cast("long").alias("label"), F.array(*[(F.col("ecm_cluster") == c).cast("double") for c in range(CLUSTERS)]).alias("x"))
    keep = nodes.select(F.col("graph").cast("int").alias("sample_id"), "node")
    edges = lattice(spark, sf).join(keep.withColumnRenamed("node", "src"), ["sample_id", "src"], "left_semi").join(keep.withColumnRenamed("node", "dst"), ["sample_id", "dst"], "left_semi")
    folds = nodes.select("graph").distinct().withColumn("fold", F.expr("cast(graph div 2 % 2 as int)"))
    return nodes, edges.select(F.col("sample_id").cast("long").alias("graph"), "src", "dst"), folds


@query("node_classifier")
def _(spark, sf):
    return rounded(nn.predictions(nn.classify(*_graphs(spark, sf))))


@query("cluster_importance")
def _(spark, sf):
    return rounded(nn.importance(*_graphs(spark, sf)).groupBy("class", "feature").agg(F.avg("attribution").alias("mean"), F.avg(F.abs("attribution")).alias("size")))


@query("masked_embeddings")
def _(spark, sf):
    nodes, edges, _folds = _graphs(spark, sf)
    z = nn.encode_masked(nodes.select(F.col("graph").alias("sample_id"), "node", "x"), edges.withColumnRenamed("graph", "sample_id"), 8)
    return rounded(z.select("sample_id", "node", F.posexplode("z").alias("k", "z")))


CHANNELS_SQL = "two AS (SELECT sample_id, 0 AS channel, y, x, v FROM pixels UNION ALL SELECT sample_id, 1, y, x, v * v / 10 FROM pixels)"


def _two_channels(spark, sf):
    own = at.pixels(spark, sf)
    return own.unionByName(own.withColumns({"channel": F.lit(1), "v": F.col("v") * F.col("v") / 10}))


@query("cohort_zscore", "SELECT sample_id, channel, y, x, round((v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w > 0 THEN stddev_pop(v) OVER w ELSE 1 END, 6) AS v FROM two WINDOW w AS (PARTITION BY channel)", PX, CHANNELS_SQL)
def _(spark, sf):
    return rounded(cohort.normalise(_two_channels(spark, sf), spark.createDataFrame([(0, True), (1, False)], "channel int, is_ecm boolean")).select("sample_id", "channel", "y", "x", "v"))


@query("cohort_arcsinh", """top AS (SELECT channel, quantile_cont(asinh(v / 5.0::DOUBLE), 0.995) AS t FROM two GROUP BY 1)
SELECT sample_id, channel, y, x, round(CASE WHEN channel = 0 AND t > 0 THEN least(greatest(asinh(v / 5.0::DOUBLE) / t, 0.0), 1.0) ELSE asinh(v / 5.0::DOUBLE) END, 6) AS v FROM two JOIN top USING (channel)""", PX, CHANNELS_SQL)
def _(spark, sf):
    channels = spark.createDataFrame([(0, True), (1, False)], "channel int, is_ecm boolean")
    return rounded(cohort.normalise(_two_channels(spark, sf), channels, "pooled_arcsinh_percentile", 5.0).select("sample_id", "channel", "y", "x", "v"))


for _mode, _rule in {"any": "max((m >= cut)::INT) = 1", "all": "min((m >= cut)::INT) = 1", "mean": "avg(m) >= avg(cut)"}.items():

    @query(f"foreground_{_mode}", f"""m AS (SELECT sample_id, channel, y // {BLOCK} AS "by", x // {BLOCK} AS bx, avg(v) AS m, CASE WHEN channel = 0 THEN 50.0::DOUBLE ELSE 400.0::DOUBLE END AS cut FROM two GROUP BY 1, 2, 3, 4)
SELECT sample_id, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx FROM m GROUP BY 1, 2, 3 HAVING {_rule}""", PX, CHANNELS_SQL)
    def _(spark, sf, mode=_mode):
        cuts = spark.createDataFrame([(0, 50.0), (1, 400.0)], "channel int, cut double")
        return cohort.foreground(patches.blocks(_two_channels(spark, sf), BLOCK), cuts, mode)


_FEATURES_SQL = """moments AS (SELECT sample_id, channel, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, avg(v) AS mean, stddev_pop(v) AS std, max(v) AS max, avg((v > mu)::INT) AS signal_fraction FROM (
  SELECT *, avg(v) OVER (PARTITION BY sample_id, channel, "by", bx) AS mu FROM blocks) q GROUP BY 1, 2, 3, 4),
entropy AS (SELECT sample_id, channel, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, -sum(p * ln(p + 1e-10)) AS entropy FROM (
  SELECT sample_id, channel, "by", bx, count(*) / sum(count(*)) OVER (PARTITION BY sample_id, channel, "by", bx)::DOUBLE AS p FROM (
    SELECT sample_id, channel, "by", bx, CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 32), 31) ELSE 0 END AS bin FROM (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM blocks WINDOW w AS (PARTITION BY sample_id, channel, "by", bx)) q) q
  GROUP BY sample_id, channel, "by", bx, bin) q GROUP BY 1, 2, 3, 4),
slopes AS (SELECT *, CASE WHEN l IS NULL AND r IS NULL THEN 0 WHEN l IS NULL THEN r - v WHEN r IS NULL THEN v - l ELSE (r - l) / 2 END AS gx,
  CASE WHEN u IS NULL AND d IS NULL THEN 0 WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END AS gy FROM (
  SELECT *, lag(v) OVER a AS l, lead(v) OVER a AS r, lag(v) OVER b AS u, lead(v) OVER b AS d FROM blocks
  WINDOW a AS (PARTITION BY sample_id, channel, "by", bx, py ORDER BY px), b AS (PARTITION BY sample_id, channel, "by", bx, px ORDER BY py)) q),
gradients AS (SELECT sample_id, channel, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, avg(sqrt(gx*gx + gy*gy)) AS gradient_magnitude,
  sqrt((avg(gx*gx) - avg(gy*gy)) ** 2 + 4 * avg(gx*gy) ** 2) / (avg(gx*gx) + avg(gy*gy) + 1e-10) AS coherence FROM slopes GROUP BY 1, 2, 3, 4)"""


@query("extract_patches", f"""{_FEATURES_SQL},
tiled AS (SELECT m.*, e.entropy, g.gradient_magnitude, g.coherence, concat_ws(':', m.sample_id, m."by" // 5, m.bx // 5) AS tile FROM moments m JOIN entropy e USING (sample_id, channel, "by", bx) JOIN gradients g USING (sample_id, channel, "by", bx)),
cuts AS (SELECT tile, quantile_cont(mean, 0.1) AS cut FROM tiled GROUP BY 1)
SELECT sample_id, channel, "by", bx, round(mean, 6) AS mean, round(std, 6) AS std, round(max, 6) AS max, round(signal_fraction, 6) AS signal_fraction, round(entropy, 6) AS entropy, round(gradient_magnitude, 6) AS gradient_magnitude,
  round(coherence, 6) AS coherence, ("by" + 0.5::DOUBLE) * {BLOCK} AS y, (bx + 0.5::DOUBLE) * {BLOCK} AS x FROM tiled JOIN cuts USING (tile) WHERE mean > cut""", PX, BLOCKS_SQL)
def _(spark, sf):
    return rounded(cohort.extract(at.pixels(spark, sf), BLOCK, by_tile=5))


def _over_sql(name: str, edges: str) -> str:
    """The tables of the descriptive enrichment over other cross edges, under names of their own."""
    out = f"{ENRICH_SQL},\n{_enriched_sql('typed')}".replace("cross_edges", edges)
    for table in ("by_cell", "freq", "met", "seen", "target", "hoped", "enriched"):
        out = re.sub(rf"\b{table}\b", f"{table}_{name}", out)
    return out


@query("topology_sensitivity", f"""typed AS (SELECT 0 AS perm, sample_id, cell_id, cell_type FROM cells),
near_edges AS (SELECT c.sample_id, cell_id AS src, patch_id AS dst FROM cells c JOIN patches p ON c.sample_id = p.sample_id WHERE (c.x-p.x)*(c.x-p.x) + (c.y-p.y)*(c.y-p.y) <= {AROUND_CELL * AROUND_CELL}),
{_over_sql("bought", "cross_edges")}, {_over_sql("near", "near_edges")}
SELECT cell_type, CAST(cluster AS INTEGER) AS cluster, observed, round(expected, 6) AS expected, round(log2, 6) AS log2, topology FROM (SELECT *, 'bought' AS topology FROM enriched_bought UNION ALL SELECT *, 'near' FROM enriched_near) q""", C, P, X)
def _(spark, sf):
    cells = at.cells(spark, sf)
    near = spatial.range_join(cells.withColumnRenamed("cell_id", "id"), at.patches(spark, sf).withColumnRenamed("patch_id", "id"), AROUND_CELL).select("sample_id", "src", "dst")
    return rounded(cohort.topology_sensitivity(cells, labels(spark, sf), {"bought": at.cross_edges(spark, sf), "near": near}, CLUSTERS))


#: Components are what samples are above; their numbers, the smallest ids, are unique.
OF_COMPONENTS = TOPOLOGY_SQL.replace("radius_edges", "own_edges").replace("points p", "own_points p").replace("SELECT l.sample_id, n AS", "SELECT c.sample_id, c.component, n AS").replace("FROM loc l LEFT JOIN len USING (sample_id)", "FROM loc l LEFT JOIN len USING (sample_id) JOIN (SELECT DISTINCT sample_id, component FROM groups) c ON c.component = l.sample_id")


@query("component_topology", f"""own_points AS (SELECT component AS sample_id, id FROM groups),
own_edges AS (SELECT component AS sample_id, src, dst, d FROM radius_edges e JOIN groups g ON g.sample_id = e.sample_id AND g.id = e.src), {OF_COMPONENTS}""", PT, RADIUS_SQL, COMPONENTS_SQL)
def _(spark, sf):
    p = at.points(spark, sf)
    edges = spatial.radius_edges(p, RADIUS)
    return rounded(cohort.component_topology(graph.components(p, edges), edges))


@query("label_scores", """tab AS (SELECT ecm_cluster AS t, patch_id * 7 % 5 AS p, count(*) AS n FROM patches WHERE ecm_cluster >= 0 GROUP BY 1, 2),
f AS (SELECT a.t, 2.0 * coalesce((SELECT n FROM tab h WHERE h.t = a.t AND h.p = a.t), 0) / (a.n + coalesce(b.n, 0)) AS f FROM (SELECT t, sum(n) AS n FROM tab GROUP BY 1) a LEFT JOIN (SELECT p, sum(n) AS n FROM tab GROUP BY 1) b ON a.t = b.p)
SELECT round((SELECT sum(CASE WHEN t = p THEN n ELSE 0 END) / sum(n)::DOUBLE FROM tab), 6) AS accuracy, round(avg(f), 6) AS macro_f1 FROM f""", P)
def _(spark, sf):
    own = at.patches(spark, sf).where("ecm_cluster >= 0")
    return rounded(cohort.label_scores(own.select(F.col("ecm_cluster").cast("long").alias("truth"), (F.col("patch_id") * 7 % 5).alias("predicted"))))


@query("pooled_centres", "SELECT ecm_cluster, count(*) AS n, round(avg(f0), 6) AS f0, round(avg(f1), 6) AS f1, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM patches WHERE ecm_cluster >= 0 GROUP BY 1", P)
def _(spark, sf):
    return rounded(cohort.pooled_centres(at.patches(spark, sf), ["f0", "f1"]))


# Joint graphs by relation, checks, and the tables behind figures.

JOINT_SQL = ORACLE_SQL["joint_graph_edges"].split("WITH RECURSIVE ", 1)[1].rsplit("SELECT CAST(sample_id AS BIGINT)", 1)[0].rstrip()


@query("hetero_relations", f"""numbered AS (SELECT sample_id, kind, id, row_number() OVER (PARTITION BY sample_id, kind ORDER BY id) - 1 AS node FROM spots),
ways AS (SELECT sample_id, src_type AS f, src AS a, dst_type AS t, dst AS b, d FROM long UNION ALL SELECT sample_id, dst_type, dst, src_type, src, d FROM long)
SELECT CAST(w.sample_id AS BIGINT) AS sample_id, f || '-' || t AS relation, m.node AS source, n.node AS target, round(d, 6) AS d, round(CASE WHEN d > 0 THEN 1 / d ELSE 0.0 END, 6) AS weight
FROM ways w JOIN numbered m ON m.sample_id = w.sample_id AND m.kind = f AND m.id = a JOIN numbered n ON n.sample_id = w.sample_id AND n.kind = t AND n.id = b""", JOINT_SQL)
def _(spark, sf):
    return rounded(hetero.hetero_tables(*_joint(spark, sf))[1])


@query("graph_changes", """eight AS (SELECT * FROM grid_edges),
four AS (SELECT a.sample_id, least(a.patch_id, b.patch_id) AS src, greatest(a.patch_id, b.patch_id) AS dst FROM patches a JOIN patches b ON a.sample_id = b.sample_id AND (b.grid_y - a.grid_y, b.grid_x - a.grid_x) IN ((0, 1), (1, 0)))
SELECT coalesce(e.sample_id, f.sample_id) AS sample_id, count(*) FILTER (WHERE f.src IS NULL) AS added, count(*) FILTER (WHERE e.src IS NULL) AS gone, count(*) FILTER (WHERE f.src IS NOT NULL AND e.src IS NOT NULL) AS kept
FROM eight e FULL JOIN four f ON e.sample_id = f.sample_id AND e.src = f.src AND e.dst = f.dst GROUP BY 1""", P, LATTICE_SQL)
def _(spark, sf):
    own = at.patches(spark, sf)
    return frames.graph_changes(spatial.grid_edges(own, 8), spatial.grid_edges(own, 4))


@query("mask_at", """edge AS (SELECT sample_id, max(y) AS h, max(x) AS w FROM pixels GROUP BY sample_id),
spots AS (SELECT p.sample_id, patch_id AS id, p.x * 1.5 - 20 AS x, p.y * 1.5 - 20 AS y FROM patches p),
cut AS (SELECT s.*, least(greatest(CAST(trunc(s.y) AS INTEGER), 0), h) AS cy, least(greatest(CAST(trunc(s.x) AS INTEGER), 0), w) AS cx FROM spots s LEFT JOIN edge e ON e.sample_id = s.sample_id)
SELECT c.sample_id, c.id, c.x, c.y, m.v AS value FROM cut c LEFT JOIN pixels m ON m.sample_id = c.sample_id AND m.y = cy AND m.x = cx""", P, PX)
def _(spark, sf):
    spots = at.patches(spark, sf).select("sample_id", F.col("patch_id").alias("id"), (F.col("x") * 1.5 - 20).alias("x"), (F.col("y") * 1.5 - 20).alias("y"))
    return frames.mask_at(spots, at.pixels(spark, sf))


@query("cohort_facts", """SELECT (SELECT count(DISTINCT grp) FROM samples WHERE sample_id IN (SELECT sample_id FROM cells)) AS n_groups, (SELECT count(DISTINCT sample_id) FROM samples WHERE sample_id IN (SELECT sample_id FROM cells)) AS n_samples,
  (SELECT count(*) FROM cells) AS n_cells, (SELECT count(DISTINCT cell_type) FROM cells) AS n_types, (SELECT count(*) FROM patches) AS n_patches, (SELECT round(avg(CASE WHEN ecm_cluster < 0 THEN 1.0 ELSE 0.0 END), 6) FROM patches) AS background""", C, P, S)
def _(spark, sf):
    return rounded(frames.facts(at.cells(spark, sf), at.patches(spark, sf), at.samples(spark, sf)))


@query("metric_bars", """SELECT sample_id AS model, CAST(row_number() OVER (ORDER BY min(id), sample_id) AS INTEGER) AS rank, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0.0), 6) AS sd, count(score) AS n FROM truth GROUP BY sample_id""", T)
def _(spark, sf):
    return rounded(frames.bars(at.truth(spark, sf).select(F.col("sample_id").alias("model"), "id", "score"), metric="score", order="id"))


#: A matrix of cell types by sample, for the heat map.
MATRIX_SQL = "matrix AS (SELECT cell_type, sample_id AS cluster, avg(marker) / 1000 AS log2, avg(CASE WHEN marker < 0 THEN 0.5 ELSE 0.0 END) AS p_fdr FROM cells GROUP BY 1, 2)"


@query("heat_map", """ordered AS (SELECT cell_type, CAST(row_number() OVER (ORDER BY max(log2) FILTER (WHERE cluster = 1) DESC NULLS LAST, cell_type) AS INTEGER) AS "row" FROM matrix GROUP BY 1)
SELECT cell_type, cluster, "row", round(least(greatest(log2, -4.0), 4.0), 6) AS shown, CASE WHEN p_fdr < 0.001 THEN '***' WHEN p_fdr < 0.01 THEN '**' WHEN p_fdr < 0.05 THEN '*' ELSE '' END AS mark FROM matrix JOIN ordered USING (cell_type)""", C, MATRIX_SQL)
def _(spark, sf):
    matrix = at.cells(spark, sf).groupBy("cell_type", F.col("sample_id").alias("cluster")).agg((F.avg("marker") / 1000).alias("log2"), F.avg(F.when(F.col("marker") < 0, 0.5).otherwise(0.0)).alias("p_fdr"))
    return rounded(frames.heat_map(matrix, 1))


ROI_SQL = ORACLE_SQL["enrichment_by_sample"].split("WITH RECURSIVE ", 1)[1].rsplit("SELECT sample_id, cell_type, CAST(cluster AS INTEGER)", 1)[0].rstrip()


@query("enrichment_by_roi", "SELECT sample_id, " + ", ".join(f"max(CASE WHEN cluster = {k} THEN round(log2((n + 1e-9) / (expected + 1e-9)), 6) END) AS c{k}" for k in range(CLUSTERS)) + " FROM hoped WHERE cell_type = 'BUILDING' GROUP BY sample_id", ROI_SQL)
def _(spark, sf):
    return rounded(frames.by_roi(stats.enrichment_by_sample(at.cells(spark, sf), labels(spark, sf), at.cross_edges(spark, sf), CLUSTERS), "BUILDING", CLUSTERS))


@query("split_report", """folds AS (SELECT cell_id AS graph, cell_type AS label, sample_id AS grp, CASE WHEN cell_id % 97 = 0 THEN 0 ELSE sample_id % 3 END AS fold FROM cells),
full_grid AS (SELECT f.fold, l.label, l.t, coalesce(n, 0) AS n FROM (SELECT DISTINCT fold FROM folds) f CROSS JOIN (SELECT label, count(*) AS t FROM folds GROUP BY 1) l LEFT JOIN (SELECT fold, label, count(*) AS n FROM folds GROUP BY 1, 2) q ON q.fold = f.fold AND q.label = l.label),
sides AS (SELECT fold, sum(n)::BIGINT AS n_test, sum(t - n)::BIGINT AS n_train, count(*) FILTER (WHERE n > 0) AS test_classes, count(*) FILTER (WHERE t > n) AS train_classes, count(*) AS k FROM full_grid GROUP BY 1),
shared AS (SELECT fold, count(DISTINCT grp) AS g FROM folds WHERE grp IN (SELECT grp FROM folds GROUP BY grp HAVING count(DISTINCT fold) > 1) GROUP BY 1)
SELECT s.fold, n_test, n_train, test_classes, train_classes, coalesce(g, 0) AS shared_groups, test_classes = k AND train_classes = k AND coalesce(g, 0) = 0 AS fine FROM sides s LEFT JOIN shared h ON s.fold = h.fold""", C)
def _(spark, sf):
    folds = at.cells(spark, sf).select(F.col("cell_id").alias("graph"), F.col("cell_type").alias("label"), F.col("sample_id").alias("grp"), F.when(F.col("cell_id") % 97 == 0, 0).otherwise(F.col("sample_id") % 3).alias("fold"))
    return checks.split_report(folds)


@query("extract_named", """SELECT sample_id, channel, "by", bx, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(max(v), 6) AS max, round(avg(CASE WHEN v > mu THEN 1.0 ELSE 0.0 END), 6) AS signal_fraction, round(max(v) - min(v), 6) AS spread, round(max(v) * 2, 6) AS twice
FROM (SELECT *, avg(v) OVER (PARTITION BY sample_id, channel, "by", bx) AS mu FROM blocks) q GROUP BY 1, 2, 3, 4""", PX, BLOCKS_SQL)
def _(spark, sf):
    spread = lambda rows: rows.groupBy(*patches.BLOCK).agg((F.max("v") - F.min("v")).alias("spread"))
    return rounded(extractors.extract(block_rows(spark, sf), ["moments", spread, extractors.of_array("twice", lambda image: 2 * image.max())]))


@query("segment_tiled")
def _(spark, sf):
    return rounded(tiled.segment_tiled(at.pixels(spark, sf), 40, 10, "triangle", 3))


@query("community_resolution")
def _(spark, sf):
    own = at.patches(spark, sf).where("ecm_cluster >= 0").select("sample_id", F.col("patch_id").alias("id"), "f0", "f1")
    spread = cluster.standardised(own, ["f0", "f1"])
    near = spatial.knn_edges(own.select("sample_id", "id", (F.col("f0") / 100).alias("x"), F.col("f1").alias("y")), 15)
    return rounded(communities.select_resolution(near, spread, [0.5, 1.0, 2.0]))
