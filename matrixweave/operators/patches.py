"""Patches: features of pixel blocks, backgrounds, labels, overlays, comparison and denoising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrixweave.operators.spatial import range_join, symmetric
from matrixweave.plans.ranges import in_ranges, with_running_sums

LEVELS, BINS = 16, 32
#: Steps to the next pixel at 0, 45, 90 and 135 degrees.
STEPS = [(0, 1), (-1, 1), (-1, 0), (-1, -1)]
BLOCK = ["sample_id", "channel", "by", "bx"]


def blocks(pixels: DataFrame, size: int) -> DataFrame:
    """``pixels(sample_id, channel, y, x, v)`` of whole size x size blocks, with their block (by, bx) and place in it (py, px)."""
    out = pixels.join(pixels.groupBy("sample_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w")), "sample_id")
    out = out.withColumns({"by": F.expr(f"y div {size}").cast("int"), "bx": F.expr(f"x div {size}").cast("int"), "py": F.col("y") % size, "px": F.col("x") % size})
    return out.where((F.col("by") < F.expr(f"_h div {size}")) & (F.col("bx") < F.expr(f"_w div {size}"))).drop("_h", "_w")


def block_moments(rows: DataFrame) -> DataFrame:
    """mean, sd (population), max, and the share of pixels over the mean."""
    mu = F.avg("v").over(Window.partitionBy(*BLOCK))
    return rows.withColumn("_mu", mu).groupBy(*BLOCK).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max("v").alias("max"), F.avg((F.col("v") > F.col("_mu")).cast("double")).alias("signal_fraction"))


def block_entropy(rows: DataFrame, eps: float = 1e-10) -> DataFrame:
    """Entropy of a histogram of BINS bins between the block's extremes, in nats; a constant block is one bin."""
    w = Window.partitionBy(*BLOCK)
    low, high = F.min("v").over(w), F.max("v").over(w)
    level = F.when(high > low, F.least(F.floor((F.col("v") - low) / (high - low) * BINS), F.lit(BINS - 1))).otherwise(0)
    counts = rows.withColumn("_bin", level).groupBy(*BLOCK, "_bin").agg(F.count("*").alias("_n"))
    share = F.col("_n") / F.sum("_n").over(w)
    return counts.withColumn("_p", share).groupBy(*BLOCK).agg((-F.sum(F.col("_p") * F.log(F.col("_p") + eps))).alias("entropy"))


def _slope(along: str, across: str) -> Column:
    """Central differences within a block, one-sided at its edges; 0 in a block of one pixel."""
    w = Window.partitionBy(*BLOCK, across).orderBy(along)
    before, after = F.lag("v").over(w), F.lead("v").over(w)
    return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - F.col("v")).when(after.isNull(), F.col("v") - before).otherwise((after - before) / 2)


def block_gradients(rows: DataFrame) -> DataFrame:
    """gradient_magnitude, and coherence of the structure tensor: (l1 - l2) / (l1 + l2 + 1e-10)."""
    g = rows.withColumns({"gx": _slope("px", "py"), "gy": _slope("py", "px")})
    t = g.groupBy(*BLOCK).agg(F.avg(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)).alias("gradient_magnitude"), F.avg(F.col("gx") ** 2).alias("_xx"), F.avg(F.col("gy") ** 2).alias("_yy"), F.avg(F.col("gx") * F.col("gy")).alias("_xy"))
    gap = F.sqrt((F.col("_xx") - F.col("_yy")) ** 2 + 4 * F.col("_xy") ** 2)
    return t.select(*BLOCK, "gradient_magnitude", (gap / (F.col("_xx") + F.col("_yy") + 1e-10)).alias("coherence"))


def block_texture(rows: DataFrame) -> DataFrame:
    """Contrast, homogeneity, energy and correlation of grey-level co-occurrence: LEVELS levels, distance 1, both ways, mean over four angles."""
    w = Window.partitionBy(*BLOCK)
    low, high = F.min("v").over(w), F.max("v").over(w)
    level = F.when(high - low >= 1e-8, ((F.col("v") - low) / (high - low) * (LEVELS - 1)).cast("int")).otherwise(0)
    own = rows.withColumn("level", level).select(*BLOCK, "py", "px", "level")
    here = own.select(*BLOCK, F.col("level").alias("i"), F.explode(F.array(*[F.struct(F.lit(a).alias("angle"), (F.col("py") + dy).alias("py"), (F.col("px") + dx).alias("px")) for a, (dy, dx) in enumerate(STEPS)])).alias("s")).select(*BLOCK, "i", "s.*")
    pairs = here.join(own.withColumnRenamed("level", "j"), [*BLOCK, "py", "px"])
    both = pairs.select(*BLOCK, "angle", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("s")).select(*BLOCK, "angle", "s.*").groupBy(*BLOCK, "angle", "i", "j").agg(F.count("*").alias("n"))
    angle = Window.partitionBy(*BLOCK, "angle")
    p = both.withColumn("p", F.col("n") / F.sum("n").over(angle))
    p = p.withColumn("mu", F.sum(F.col("p") * F.col("i")).over(angle))
    d2 = (F.col("i") - F.col("j")) ** 2
    by_angle = p.groupBy(*BLOCK, "angle").agg(
        F.sum(F.col("p") * d2).alias("contrast"), F.sum(F.col("p") / (1 + d2)).alias("homogeneity"), F.sqrt(F.sum(F.col("p") ** 2)).alias("energy"),
        F.sum(F.col("p") * (F.col("i") - F.col("mu")) * (F.col("j") - F.col("mu"))).alias("_cov"), F.sum(F.col("p") * (F.col("i") - F.col("mu")) ** 2).alias("_var"),
    )
    by_angle = by_angle.withColumn("correlation", F.when(F.col("_var") < 1e-15, 1.0).otherwise(F.col("_cov") / F.col("_var")))
    return by_angle.groupBy(*BLOCK).agg(*[F.avg(c).alias(f"glcm_{c}") for c in ("contrast", "homogeneity", "energy", "correlation")])


def signal_blocks(features: DataFrame, quantile: float = 0.1, value: str = "mean", by: str | None = None) -> DataFrame:
    """Rows over the ``quantile`` of ``value``; of the whole table, or by a column (such as a tile)."""
    keys = [by] if by else []
    cut = features.groupBy(*keys).agg(F.percentile(value, F.lit(quantile)).alias("_cut"))
    joined = features.join(cut, keys) if keys else features.crossJoin(F.broadcast(cut))
    return joined.where(F.col(value) > F.col("_cut")).drop("_cut")


def two_means(values: DataFrame, v: str = "v") -> DataFrame:
    """(threshold): midway between the two means that split the positive values with least squared error; infinite without any.

    Values are counted first, so that equal ones are one row; the split is read off
    running sums over ranges of values.
    """
    own = values.where(F.col(v) > 0).groupBy(F.col(v).alias("v")).agg(F.count("*").alias("n"))
    s = with_running_sums(in_ranges(own, "v", "two-means"), "v", _n=F.col("n"), _s=F.col("n") * F.col("v"))
    s = s.withColumnsRenamed({"_n_all": "_all", "_s_all": "_whole"})
    rest = F.col("_all") - F.col("_n")
    gain = F.col("_s") ** 2 / F.col("_n") + F.when(rest > 0, (F.col("_whole") - F.col("_s")) ** 2 / F.nullif(rest, F.lit(0))).otherwise(0.0)
    middle = F.when(rest > 0, (F.col("_s") / F.col("_n") + (F.col("_whole") - F.col("_s")) / F.nullif(rest, F.lit(0))) / 2).otherwise(F.col("_s") / F.col("_n"))
    best = s.withColumns({"_gain": gain, "_mid": middle}).agg(F.max_by("_mid", F.struct("_gain", -F.col("v"))).alias("threshold"))
    return best.select(F.coalesce("threshold", F.lit(float("inf"))).alias("threshold"))


def paint(pixels: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(sample_id, y, x, label) of every pixel: its block's label, -1 where it has none."""
    at = pixels.select("sample_id", "y", "x", F.expr(f"cast(y div {size} as int)").alias("by"), F.expr(f"cast(x div {size} as int)").alias("bx")).distinct()
    return at.join(labels.select("sample_id", "by", "bx", "label"), ["sample_id", "by", "bx"], "left").select("sample_id", "y", "x", F.coalesce("label", F.lit(-1)).alias("label"))


def top_hat(pixels: DataFrame, radius: int = 5) -> DataFrame:
    """``v`` less its opening by a disk: the largest over the disk of the smallest over the disk; outside the image nothing counts.

    A pixel sends its value to the disk around it and the extremes are pre-aggregated;
    no image has to fit one task.
    """
    disk = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    key = ["sample_id", "channel", "y", "x"]
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disk])

    def spread(df: DataFrame, fold) -> DataFrame:
        sent = df.select("sample_id", "channel", "y", "x", "v", F.explode(steps).alias("s")).select("sample_id", "channel", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "v")
        return sent.groupBy(*key).agg(fold("v").alias("v")).join(df.select(*key), key, "left_semi")

    own = pixels.select(*key, "v")
    opened = spread(spread(own, F.min), F.max)
    return own.join(opened.withColumnRenamed("v", "_o"), key).select(*key, (F.col("v") - F.col("_o")).alias("v"))


def cell_means(mask: DataFrame, pixels: DataFrame) -> DataFrame:
    """(sample_id, label, channel, mean, area, y, x) of each label over 0 of ``mask(sample_id, y, x, label)``."""
    return mask.where("label > 0").join(pixels, ["sample_id", "y", "x"]).groupBy("sample_id", "label", "channel").agg(F.avg("v").alias("mean"), F.count("*").alias("area"), F.avg("y").alias("y"), F.avg("x").alias("x"))


def window_means(cells: DataFrame, pixels: DataFrame, radius: int = 3) -> DataFrame:
    """(sample_id, cell_id, channel, mean) over the square of ``radius`` around each cell's truncated centre, within the image.

    Squares are summed once a place, however many cells are there, and never broadcast.
    """
    reach = list(range(-radius, radius + 1))
    own = cells.select("sample_id", "cell_id", F.col("y").cast("int").alias("_y"), F.col("x").cast("int").alias("_x"))
    at = own.select("sample_id", "_y", "_x").distinct()
    at = at.withColumn("dy", F.explode(F.array(*map(F.lit, reach)))).withColumn("dx", F.explode(F.array(*map(F.lit, reach))))
    at = at.select("sample_id", "_y", "_x", (F.col("_y") + F.col("dy")).alias("y"), (F.col("_x") + F.col("dx")).alias("x"))
    sums = at.hint("merge").join(pixels, ["sample_id", "y", "x"]).groupBy("sample_id", "_y", "_x", "channel").agg(F.sum("v").alias("_s"), F.count("v").alias("_n"))
    return own.join(sums, ["sample_id", "_y", "_x"]).groupBy("sample_id", "cell_id", "channel").agg((F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean"))


def relabel_background(patches: DataFrame, value: str, order: str = "size") -> DataFrame:
    """``patches`` with label: the cluster of lowest mean is -1, others are numbered from 0 by size (largest first) or by id."""
    stats = patches.groupBy("ecm_cluster").agg(F.avg(value).alias("_m"), F.count("*").alias("_n"))
    dim = stats.agg(F.min_by("ecm_cluster", F.struct("_m", "ecm_cluster")).alias("_dim"))
    ranked = stats.crossJoin(F.broadcast(dim)).where("ecm_cluster <> _dim")
    by = [F.desc("_n"), F.asc("ecm_cluster")] if order == "size" else [F.asc("ecm_cluster")]
    ranked = ranked.select("ecm_cluster", (F.row_number().over(Window.orderBy(*by)) - 1).alias("label"))
    return patches.join(F.broadcast(ranked), "ecm_cluster", "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def apply_overlay(patches: DataFrame, overlay: DataFrame, most_mismatch: float = 0.01) -> DataFrame:
    """``patches`` with label: the overlay's replacement where it marks an artefact.

    ``overlay(patch_id, is_artifact, replacement, reference)``; a sample whose labels
    differ from the reference in more than ``most_mismatch`` of its rows is an error.
    """
    joined = patches.join(overlay, ["sample_id", "patch_id"] if "sample_id" in overlay.columns else "patch_id", "left")
    off = F.avg((F.col("ecm_cluster") != F.col("reference")).cast("double")).over(Window.partitionBy("sample_id"))
    checked = joined.withColumn("_off", F.coalesce(off, F.lit(0.0)))
    bad = F.raise_error(F.concat(F.lit("labels differ from the overlay's reference in sample "), F.col("sample_id").cast("string")))
    label = F.when(F.col("is_artifact"), F.col("replacement")).otherwise(F.col("ecm_cluster"))
    return checked.withColumn("label", F.when(F.col("_off") > most_mismatch, bad.cast("int")).otherwise(label)).drop("_off", "replacement", "reference")


def overlay_summary(patches: DataFrame) -> DataFrame:
    """Per sample of ``patches(sample_id, ecm_cluster, label, is_artifact)``: patches, signal, artefacts, changed labels."""
    n = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    return patches.groupBy("sample_id").agg(F.count("*").alias("n_patches"), n(F.col("label") >= 0).alias("n_signal"), n(F.col("is_artifact")).alias("n_artifacts"), n(F.col("label") != F.col("ecm_cluster")).alias("n_changed"))


def compare(observed: DataFrame, reference: DataFrame, values: list[str], label: str = "ecm_cluster", atol: float = 1e-6, rtol: float = 1e-5) -> DataFrame:
    """Per sample: rows, rows of which all values are close, and equal labels."""
    other = reference.select("sample_id", "patch_id", *[F.col(v).alias(f"_{v}") for v in values], F.col(label).alias("_label"))
    close = F.lit(True)
    for v in values:
        close = close & (F.abs(F.col(v) - F.col(f"_{v}")) <= atol + rtol * F.abs(F.col(f"_{v}")))
    both = observed.join(other, ["sample_id", "patch_id"])
    return both.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum(close.cast("long")).alias("n_close"), F.sum((F.col(label) == F.col("_label")).cast("long")).alias("n_labels"))


def neighbour_shares(edges: DataFrame, labels: DataFrame, k: int, background: int = -1) -> DataFrame:
    """(sample_id, id, label, share): shares of signal neighbours' labels around each node; nodes without any have no row."""
    both = symmetric(edges.select("sample_id", "src", "dst"))
    near = both.join(labels.where((F.col("label") != background) & (F.col("label") < k)).select("sample_id", F.col("id").alias("dst"), "label"), ["sample_id", "dst"])
    counts = near.groupBy("sample_id", F.col("src").alias("id"), "label").agg(F.count("*").alias("n"))
    return counts.select("sample_id", "id", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("sample_id", "id"))).alias("share"))


def prior_scores(train: DataFrame, labels: DataFrame, eps: float = 1e-9) -> DataFrame:
    """``labels`` plus score: -ln(share of the label among training signal + eps), 0 for labels not seen."""
    counts = train.where("label >= 0").groupBy("label").agg(F.count("*").alias("_n"))
    prior = counts.select("label", (-F.log(F.col("_n") / F.sum("_n").over(Window.partitionBy()) + eps)).alias("score"))
    return labels.join(F.broadcast(prior), "label", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def denoise(patches: DataFrame, threshold: float = 0.3, radius: float = 14.0, least: int = 2) -> DataFrame:
    """``patches`` with denoised: the predicted label where a candidate has ``least`` other candidates within ``radius``.

    ``patches(sample_id, id, x, y, label, predicted, anomaly)``.  Candidates are signal,
    predicted as another signal label, and at least ``threshold`` anomalous.
    """
    candidates = patches.where((F.col("label") >= 0) & (F.col("predicted") >= 0) & (F.col("predicted") != F.col("label")) & (F.col("anomaly") >= threshold)).select("sample_id", "id", "x", "y")
    near = range_join(candidates, candidates, radius).where("src <> dst").groupBy("sample_id", F.col("src").alias("id")).agg(F.count("*").alias("_near"))
    out = patches.join(near, ["sample_id", "id"], "left")
    return out.withColumn("denoised", F.when(F.col("_near") >= least, F.col("predicted")).otherwise(F.col("label"))).drop("_near")
