"""Graph measures on edge tables.  Undirected edges are stored once, src < dst."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixweave.operators.spatial import radius_edges, symmetric
from matrixweave.plans.scratch import written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, id, component) of all ``nodes(sample_id, id)``; component is the smallest id reachable.

    Large-star and small-star steps on written tables until no edge changes; minima are
    pre-aggregated, so a node of very many neighbours is a join that Spark can split.
    """
    key = ["sample_id", "u"]
    now = written(edges.where("src <> dst").select("sample_id", F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "components")
    seen = None
    while True:
        both = now.unionByName(now.select("sample_id", F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written apart from their joins, so that Spark can split a node of very many neighbours.
        low = written(both.groupBy(*key).agg(F.least(F.col("u"), F.min("v")).alias("m")), "components")
        large = both.join(low, key).where("v > u").select("sample_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "components")
        low = written(large.groupBy(*key).agg(F.min("v").alias("m")), "components")
        small = large.join(low, key).where("v <> m").select("sample_id", F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(low.select("sample_id", "u", F.col("m").alias("v"))).distinct(), "components")
        sign = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("sample_id", "u", "v"))).first())
        if sign == seen:
            break
        seen = sign
    return nodes.select("sample_id", "id").join(now.select("sample_id", F.col("u").alias("id"), F.col("v").alias("component")), ["sample_id", "id"], "left").withColumn("component", F.coalesce("component", "id"))


def components_reconnected(points: DataFrame, radius: float, least: int = 1) -> DataFrame:
    """Components of points linked within ``radius``: their size, edges, centre, and whether they have ``least`` nodes."""
    edges = written(radius_edges(points, radius), "reconnected")
    groups = written(components(points, edges), "reconnected")
    n_edges = edges.join(groups.withColumnRenamed("id", "src"), ["sample_id", "src"]).groupBy("sample_id", "component").agg(F.count("*").alias("n_edges"))
    own = points.join(groups, ["sample_id", "id"]).groupBy("sample_id", "component").agg(F.count("*").alias("n_nodes"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return own.join(n_edges, ["sample_id", "component"], "left").withColumns({"n_edges": F.coalesce("n_edges", F.lit(0)), "kept": F.col("n_nodes") >= least})


def largest_component(records: DataFrame) -> DataFrame:
    """Each sample's component of most nodes; ties go to the smaller first node."""
    w = Window.partitionBy("sample_id").orderBy(F.desc("n_nodes"), "component")
    return records.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, id, degree), isolated nodes included."""
    got = symmetric(edges.select("sample_id", "src", "dst")).groupBy("sample_id", F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("sample_id", "id").join(got, ["sample_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per sample: counts, density, degree and edge-length statistics, mean local clustering, transitivity.

    Triangles are counted from canonical pairs a < b < c, each once: each edge is held
    by its end of smaller degree, so that a hub's pairs are not enumerated.
    """
    deg = written(degrees(nodes, edges), "degrees")
    sizes = deg.groupBy("sample_id").agg(F.count("*").alias("n_nodes"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"), F.stddev_pop("degree").alias("sd_degree"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("_wedges"))
    lengths = edges.groupBy("sample_id").agg(F.count("*").alias("n_edges"), F.avg("d").alias("mean_length"), F.percentile("d", F.lit(0.5)).alias("median_length"), F.max("d").alias("max_length"))
    triangles = written(triangle_corners(deg, edges), "triangles")
    local = deg.join(triangles, ["sample_id", "id"], "left").withColumn("_c", F.when(F.col("degree") > 1, 2 * F.coalesce("triangles", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))
    local = local.groupBy("sample_id").agg(F.avg("_c").alias("clustering"), F.sum(F.coalesce("triangles", F.lit(0))).alias("_corners"))
    out = sizes.join(lengths, "sample_id", "left").join(local, "sample_id").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    big = F.col("n_nodes") > 2
    return out.select(
        "sample_id", "n_nodes", "n_edges",
        F.when(F.col("n_nodes") > 1, 2 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0).alias("density"),
        "mean_degree", "max_degree", "sd_degree", "mean_length", "median_length", "max_length",
        F.when(big, F.col("clustering")).alias("clustering"),
        F.when(big, F.when(F.col("_wedges") > 0, F.col("_corners") / F.col("_wedges")).otherwise(0.0)).alias("transitivity"),
    )


def triangle_corners(deg: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, id, triangles) of nodes in a triangle."""
    ends = edges.select("sample_id", "src", "dst").where("src <> dst")
    for end in ("src", "dst"):
        ends = ends.join(deg.select("sample_id", F.col("id").alias(end), F.col("degree").alias(f"_{end}")), ["sample_id", end])
    first = (F.col("_src") < F.col("_dst")) | ((F.col("_src") == F.col("_dst")) & (F.col("src") < F.col("dst")))
    out = written(ends.select("sample_id", F.when(first, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("b")).distinct(), "oriented")
    wedges = out.join(out.select("sample_id", "a", F.col("b").alias("c")), ["sample_id", "a"]).where("b < c")
    closed = out.select("sample_id", F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    corners = wedges.join(closed, ["sample_id", "b", "c"]).select("sample_id", F.explode(F.array("a", "b", "c")).alias("id"))
    return corners.groupBy("sample_id", "id").agg(F.count("*").alias("triangles"))


def core_numbers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, id, core): the largest k of a subgraph in which the node has degree k.

    Every node's value falls to the h-index of its neighbours' values until nothing
    changes, which peels all levels at once.
    """
    both = written(symmetric(edges.where("src <> dst").select("sample_id", "src", "dst")).distinct(), "core-edges")
    now = written(degrees(nodes, edges.where("src <> dst")).withColumnRenamed("degree", "core"), "core")
    while True:
        near = both.join(now.select("sample_id", F.col("id").alias("dst"), "core"), ["sample_id", "dst"])
        w = Window.partitionBy("sample_id", "src").orderBy(F.desc("core"))
        h = near.withColumn("_r", F.row_number().over(w)).groupBy("sample_id", F.col("src").alias("id")).agg(F.max(F.least("_r", "core")).alias("_h"))
        after = now.join(h, ["sample_id", "id"], "left").select("sample_id", "id", F.least("core", F.coalesce("_h", F.lit(0))).alias("core"), F.col("core").alias("_was"))
        after = written(after, "core")
        if after.where("core <> _was").isEmpty():
            return after.drop("_was")
        now = after.drop("_was")


def modularity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Per sample: share of edges within a label less the sum of squared degree shares, within [0, 1]; 0 without edges."""
    of = lambda end: labels.select("sample_id", F.col("id").alias(end), F.col("label").alias(f"_{end}"))
    joined = edges.select("sample_id", "src", "dst").join(of("src"), ["sample_id", "src"]).join(of("dst"), ["sample_id", "dst"])
    inside = joined.groupBy("sample_id").agg(F.count("*").alias("_m"), F.sum((F.col("_src") == F.col("_dst")).cast("long")).alias("_in"))
    shares = joined.select("sample_id", F.explode(F.array("_src", "_dst")).alias("label")).groupBy("sample_id", "label").agg(F.count("*").alias("_deg"))
    shares = shares.join(inside, "sample_id").groupBy("sample_id").agg(F.sum((F.col("_deg") / (2 * F.col("_m"))) ** 2).alias("_s"), F.first("_in").alias("_in"), F.first("_m").alias("_m"))
    out = labels.select("sample_id").distinct().join(shares, "sample_id", "left")
    return out.select("sample_id", F.coalesce(F.least(F.greatest(F.col("_in") / F.col("_m") - F.col("_s"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("modularity"))


def coherence(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, label, coherence): share of a label's nodes in its largest component over edges within the label."""
    of = lambda end: labels.select("sample_id", F.col("id").alias(end), F.col("label").alias(f"_{end}"))
    same = edges.select("sample_id", "src", "dst").join(of("src"), ["sample_id", "src"]).join(of("dst"), ["sample_id", "dst"]).where("_src = _dst").select("sample_id", "src", "dst")
    groups = components(labels.select("sample_id", "id"), same).join(labels, ["sample_id", "id"])
    sizes = groups.groupBy("sample_id", "label", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("sample_id", "label").agg((F.max("n") / F.sum("n")).alias("coherence"))


def contact(nodes: DataFrame, edges: DataFrame, threshold: int = 0) -> DataFrame:
    """Per cell of ``nodes(sample_id, id)``: distinct patches of weight other than 0 linked, and whether more than ``threshold``."""
    live = edges.where("weight <> 0") if "weight" in edges.columns else edges
    got = live.select("sample_id", "src", "dst").distinct().groupBy("sample_id", F.col("src").alias("id")).agg(F.count("*").alias("ecm_degree"))
    out = nodes.select("sample_id", "id").join(got, ["sample_id", "id"], "left").withColumn("ecm_degree", F.coalesce("ecm_degree", F.lit(0)))
    return out.withColumn("ecm_contact", (F.col("ecm_degree") > threshold).cast("int"))


def smooth(signal: DataFrame, edges: DataFrame, alpha: float = 0.75, steps: int = 12) -> DataFrame:
    """``signal(sample_id, id, value)`` after steps of (1 - alpha) x + alpha * weighted mean of neighbours with a value.

    Null and NaN values stay, and take no part; so do nodes without a neighbour that has one.
    """
    both = edges.where("weight > 0").select("sample_id", "src", "dst", "weight")
    both = written(symmetric(both), "smooth-edges")
    now = signal.select("sample_id", "id", F.when(~F.isnan("value"), F.col("value")).alias("value"))
    for step in range(steps):
        near = both.join(now.where("value is not null").select("sample_id", F.col("id").alias("dst"), "value"), ["sample_id", "dst"])
        mean = near.groupBy("sample_id", F.col("src").alias("id")).agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("_m"))
        now = now.join(mean, ["sample_id", "id"], "left").select("sample_id", "id", F.when(F.col("value").isNotNull(), F.when(F.col("_m").isNotNull(), (1 - alpha) * F.col("value") + alpha * F.col("_m")).otherwise(F.col("value"))).alias("value"))
        if step % 3 == 2:
            now = written(now, "smooth")
    return now


def neighbour_agreement(labels: DataFrame, edges: DataFrame, subset: str = "picked", background: int = -1) -> DataFrame:
    """Per sample: mean share of signal neighbours with the node's label over picked signal nodes, and how many have none."""
    signal = labels.where(F.col("label") != background)
    both = symmetric(edges.select("sample_id", "src", "dst"))
    own = signal.where(subset).select("sample_id", F.col("id").alias("src"), F.col("label").alias("_a"))
    near = both.join(own, ["sample_id", "src"]).join(signal.select("sample_id", F.col("id").alias("dst"), F.col("label").alias("_b")), ["sample_id", "dst"])
    rate = near.groupBy("sample_id", "src").agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("_r"))
    rate = own.join(rate, ["sample_id", "src"], "left")
    return rate.groupBy("sample_id").agg(F.avg("_r").alias("agreement"), F.count("_r").alias("n_scored"), F.sum(F.col("_r").isNull().cast("long")).alias("n_unscored"))


def joint_summary(cells: DataFrame, patches: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Per sample: counts of nodes by type and of edges by layer."""
    parts = [cells.select("sample_id", F.lit("nodes:cell").alias("part")), patches.select("sample_id", F.lit("nodes:ecm").alias("part"))]
    parts += [e.select("sample_id", F.lit(f"edges:{name}").alias("part")) for name, e in layers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("sample_id", "part").agg(F.count("*").alias("n"))
