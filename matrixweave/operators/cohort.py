"""Whole-cohort steps: shared normalisation, patch extraction, comparison of graph forms, component reports, label scores."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixweave.operators import graph, patches, stats

NORMALISATIONS = ("pooled_zscore", "pooled_arcsinh_percentile", "none")


def normalise(pixels: DataFrame, channels: DataFrame, method: str = "pooled_zscore", cofactor: float = 1.0, share: float = 0.995) -> DataFrame:
    """``pixels`` with v on one scale a channel for all samples.  ``channels(channel, is_ecm)``.

    pooled_zscore: by mean and population deviation (0 counts as 1).
    pooled_arcsinh_percentile: asinh(v / cofactor), over its ``share`` quantile and within
    [0, 1] for matrix channels whose quantile is above 0.  A channel's moments are one row.
    """
    if method not in NORMALISATIONS:
        raise ValueError(f"normalisations are {', '.join(NORMALISATIONS)}, not {method!r}")
    if method == "none":
        return pixels
    if method == "pooled_zscore":
        m = pixels.groupBy("channel").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
        value = (F.col("v") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
        return pixels.join(F.broadcast(m), "channel").withColumn("v", value).drop("_m", "_s")
    scaled = pixels.withColumn("v", F.asinh(F.col("v") / F.lit(float(cofactor))))
    top = scaled.groupBy("channel").agg(F.percentile("v", F.lit(share)).alias("_t")).join(channels, "channel")
    over = F.col("is_ecm") & (F.col("_t") > 0)
    value = F.when(over, F.least(F.greatest(F.col("v") / F.col("_t"), F.lit(0.0)), F.lit(1.0))).otherwise(F.col("v"))
    return scaled.join(F.broadcast(top), "channel").withColumn("v", value).drop("_t", "is_ecm")


def foreground(blocks: DataFrame, cuts: DataFrame, mode: str = "any") -> DataFrame:
    """(sample_id, by, bx) of blocks whose channel means reach the channels' ``cuts(channel, cut)``: in any channel, in all, or on average over channels."""
    if mode not in ("any", "all", "mean"):
        raise ValueError("foreground modes are any, all and mean")
    means = blocks.groupBy("sample_id", "channel", "by", "bx").agg(F.avg("v").alias("m")).join(F.broadcast(cuts), "channel")
    fold = {"any": F.max((F.col("m") >= F.col("cut")).cast("int")) == 1, "all": F.min((F.col("m") >= F.col("cut")).cast("int")) == 1, "mean": F.avg("m") >= F.avg("cut")}[mode]
    return means.groupBy("sample_id", "by", "bx").agg(fold.alias("_on")).where("_on").drop("_on")


def extract(pixels: DataFrame, size: int, quantile: float = 0.1, by_tile: int | None = None) -> DataFrame:
    """Patches of ``pixels``: features of each block, background under ``quantile`` of the mean dropped; over all, or tile by tile of ``by_tile`` blocks."""
    rows = patches.blocks(pixels, size)
    found = functools.reduce(lambda a, b: a.join(b, patches.BLOCK), [patches.block_moments(rows), patches.block_entropy(rows), patches.block_gradients(rows)])
    if by_tile:
        found = found.withColumn("tile", F.concat_ws(":", "sample_id", F.expr(f"`by` div {by_tile}"), F.expr(f"bx div {by_tile}")))
        found = patches.signal_blocks(found, quantile, by="tile").drop("tile")
    else:
        found = patches.signal_blocks(found, quantile)
    return found.withColumns({"y": (F.col("by") + 0.5) * size, "x": (F.col("bx") + 0.5) * size})


def topology_sensitivity(cells: DataFrame, labels: DataFrame, graphs: dict[str, DataFrame], k: int, n_perm: int = 0, seed: int = 0) -> DataFrame:
    """(cell_type, cluster, topology, log2, …): the enrichment over each way of joining cells and patches."""
    return functools.reduce(DataFrame.unionByName, [stats.enrichment(cells, labels, g, k, n_perm, seed).withColumn("topology", F.lit(name)) for name, g in graphs.items()])


def component_topology(groups: DataFrame, edges: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Topology of each component of ``groups(sample_id, id, component)``, with the samples' columns that it has none of itself."""
    key = F.struct("sample_id", "component").alias("sample_id")
    nodes = groups.select(key, "id")
    own = edges.join(groups.select("sample_id", F.col("id").alias("src"), "component"), ["sample_id", "src"]).select(key, "src", "dst", "d")
    out = graph.topology(nodes, own)
    out = out.select("sample_id.sample_id", "sample_id.component", *[c for c in out.columns if c != "sample_id"])
    if samples is None:
        return out
    return out.join(samples.select("sample_id", *[c for c in samples.columns if c not in out.columns]), "sample_id", "left")


def label_scores(rows: DataFrame) -> DataFrame:
    """(accuracy, macro_f1) of ``rows(truth, predicted)``; a class that is never right has F1 of 0."""
    table = rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    true, called = (table.groupBy(F.col(c).alias("c")).agg(F.sum("n").alias(a)) for c, a in (("truth", "t"), ("predicted", "p")))
    hit = table.where("truth = predicted").select(F.col("truth").alias("c"), F.col("n").alias("h"))
    f1 = true.join(called, "c", "left").join(hit, "c", "left").select((2 * F.coalesce("h", F.lit(0)) / (F.col("t") + F.coalesce("p", F.lit(0)))).alias("f"))
    right = table.agg((F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return right.crossJoin(f1.agg(F.avg("f").alias("macro_f1")))  # one row each


def pooled_centres(rows: DataFrame, features: list[str], label: str = "ecm_cluster") -> DataFrame:
    """(label, n, mean of each feature), with each label's share of the signal."""
    out = rows.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features])
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
