"""Contingency statistics, permutation nulls by hashed ranks, curves and summaries.

Permutations are ranks by a hash of (seed, permutation, id) within a sample: they keep
label counts, don't depend on partitioning, and SQL can repeat them.  Ids are those of
their sample: every join is on sample_id too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrixweave.functions.scale import benjamini_hochberg

EPS = 1e-9
#: Permutations that one task deals, and the prime and factors of their hash.
BATCH, PRIME, FACTORS = 250, 2**31 - 1, (16807, 48271, 69621, 40692)


def _mean_of(v: str, by: list[str]) -> Column:
    return F.avg(v).over(Window.partitionBy(*by))


def composition(labels: DataFrame, samples: DataFrame, drop_background: bool = True) -> tuple[DataFrame, DataFrame]:
    """Shares of each label by sample (0 where absent), and their unweighted means by group.

    ``labels(sample_id, label)``; nulls don't count, and negative labels only if kept.
    """
    own = labels.where(F.col("label").isNotNull())
    counts = own.groupBy("sample_id", "label").agg(F.count("*").alias("n"))
    used = counts.where("label >= 0") if drop_background else counts
    grid = own.select("sample_id").distinct().crossJoin(F.broadcast(used.select("label").distinct()))
    full = grid.join(used, ["sample_id", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("sample_id"))
    shares = full.select("sample_id", "label", F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("share"))
    return shares, shares.join(samples, "sample_id").groupBy("grp", "label").agg(F.avg("share").alias("share"))


def cooccurrence(labels: DataFrame, edges: DataFrame, k: int, eps: float = EPS) -> DataFrame:
    """(i, j, observed, expected, log2) over all samples; the diagonal counts once, other pairs both ways.

    Labels outside 0..k-1 are skipped, in pairs and in the marginals.
    """
    own = labels.where((F.col("label") >= 0) & (F.col("label") < k))
    of = lambda end: own.select("sample_id", F.col("id").alias(end), F.col("label").alias(f"_{end}"))
    pairs = edges.select("sample_id", "src", "dst").join(of("src"), ["sample_id", "src"]).join(of("dst"), ["sample_id", "dst"]).groupBy(F.col("_src").alias("i"), F.col("_dst").alias("j")).agg(F.count("*").alias("n"))
    both = pairs.unionByName(pairs.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy("i", "j").agg(F.sum("n").alias("observed"))
    spark = labels.sparkSession
    side = spark.range(k).select(F.col("id").cast("int").alias("i"))
    share = own.groupBy(F.col("label").cast("int").alias("i")).agg(F.count("*").alias("n"))
    share = side.join(share, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))
    share = share.select("i", (F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1))).alias("p"))
    grid = share.withColumnRenamed("p", "p_i").crossJoin(share.select(F.col("i").alias("j"), F.col("p").alias("p_j")))
    out = grid.join(both.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "observed"), ["i", "j"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)).cast("double"))
    out = out.withColumn("expected", F.sum("observed").over(Window.partitionBy()) * F.col("p_i") * F.col("p_j"))
    return out.select("i", "j", "observed", "expected", F.when(F.col("expected") > 0, F.log2((F.col("observed") + eps) / F.col("expected"))).otherwise(0.0).alias("log2"))


def interactions(cells: DataFrame, labels: DataFrame, cross: DataFrame) -> DataFrame:
    """(cell_type, label, n) of cross edges, zero-filled; background is a label like any other here."""
    n = cross.join(cells.select("sample_id", F.col("cell_id").alias("src"), "cell_type"), ["sample_id", "src"]).join(labels.select("sample_id", F.col("id").alias("dst"), "label"), ["sample_id", "dst"])
    n = n.groupBy("cell_type", "label").agg(F.count("*").alias("n"))
    grid = cells.select("cell_type").distinct().crossJoin(F.broadcast(labels.select("label").distinct()))
    return grid.join(n, ["cell_type", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def deal_hash(ids: np.ndarray, perm: int, seed: int) -> np.ndarray:
    """What the rows of a sample are ranked by in a permutation; all steps stay under 2^63."""
    f, g, h, k = FACTORS
    a = (ids % PRIME * f + perm * g + seed) % PRIME
    c = (a * a % PRIME * h + a * k + perm) % PRIME
    return (c * c + a) % PRIME


def dealt_counts(units: DataFrame, weights: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(perm, sample_id, value, other, n) for perm 0 to n - 1: sums of ``weights(sample_id, id, other, m)`` by the value dealt to the id.

    ``units(sample_id, id, value)``: the values of a sample are dealt anew among its rows,
    a row of hash rank r gets that of the r-th id; perm 0 is as it was.  Counts of zero
    have no row.  A task holds the rows of one sample, as two codes each and the weights,
    for ``BATCH`` permutations; only counts leave it.
    """
    kinds = dict(units.dtypes)["value"], dict(weights.dtypes)["other"]
    per = weights.groupBy("sample_id", "id").agg(F.collect_list(F.struct("other", F.col("m").cast("double").alias("m"))).alias("w"))
    rows = units.select("sample_id", F.col("id").cast("long").alias("id"), "value").join(per, ["sample_id", "id"], "left")
    rows = rows.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // BATCH))))

    def deal(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids = np.asarray(table.column("id"))
        value = table.column("value").combine_chunks().dictionary_encode("encode")
        lists = table.column("w").combine_chunks()
        flat = lists.flatten()
        other = flat.field("other").dictionary_encode("encode")
        row = np.repeat(np.arange(len(ids)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        codes, others, m = np.asarray(value.indices), np.asarray(other.indices), np.asarray(flat.field("m"))
        wide = max(1, len(other.dictionary))
        found = []
        for perm in range(key[1].as_py() * BATCH, min((key[1].as_py() + 1) * BATCH, n)):
            moved = codes
            if perm:
                moved = np.empty_like(codes)
                moved[np.argsort(deal_hash(ids, perm, seed), kind="stable")] = codes
            count = np.bincount(moved[row] * wide + others, m)
            at = np.flatnonzero(count)
            found.append((np.full(len(at), perm), at, count[at]))
        perm, at, count = map(np.concatenate, zip(*found))
        return pa.table(
            [pa.array(perm, pa.int32()), pa.array([key[0].as_py()] * len(perm), key[0].type), value.dictionary.take(pa.array(at // wide)), other.dictionary.take(pa.array(at % wide)), pa.array(count.astype(np.int64))],
            ["perm", "sample_id", "value", "other", "n"],
        )

    return rows.groupBy("sample_id", "batch").applyInArrow(deal, f"perm int, sample_id {dict(units.dtypes)['sample_id']}, value {kinds[0]}, other {kinds[1]}, n long")


def hash_rank(df: DataFrame, key: str, seed: int, *by: str) -> Column:
    """The rank of a row among those of ``by`` in the order of its hash."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(b).cast("string") for b in by], F.col(key).cast("string"))), key))


def permuted(df: DataFrame, key: str, value: str, n: int, seed: int = 0, within: str = "sample_id") -> DataFrame:
    """(perm, within, key, value) for perm 0 to n - 1: ``value`` dealt anew among the rows of each sample; perm 0 is as it was."""
    base = df.select(within, key, value).withColumn("_pos", F.row_number().over(Window.partitionBy(within).orderBy(key)))
    spread = base.crossJoin(F.broadcast(df.sparkSession.range(1, n).select(F.col("id").cast("int").alias("perm"))))
    ranked = spread.withColumn("_r", hash_rank(spread, key, seed, within, "perm"))
    values = base.select(within, F.col("_pos").alias("_r"), F.col(value).alias("_v"))
    moved = ranked.join(values, [within, "_r"]).select("perm", within, key, F.col("_v").alias(value))
    return moved.unionByName(base.select(F.lit(0).alias("perm"), within, key, value))


def enrichment(cells: DataFrame, labels: DataFrame, cross: DataFrame, k: int, n_perm: int = 0, seed: int = 0, eps: float = EPS) -> DataFrame:
    """(cell_type, cluster, observed, expected, log2[, p, p_fdr]) over all samples, for every cell type.

    Expected: each sample's share of edges to a cluster times the type's edges there.
    The null deals cell types anew within samples on the fixed graph; p counts
    permutations at least as far from 0 in log2, with one added to both sides, and
    p_fdr is over the whole matrix.  Edges are counted by cell and cluster once, and
    permutations meet those counts only.  Joins with all cells or patches are merged: several
    of them in one plan would each be broadcast.
    """
    own = labels.where((F.col("label") >= 0) & (F.col("label") < k)).select("sample_id", F.col("id").alias("dst"), F.col("label").cast("int").alias("cluster"))
    by_cell = cross.join(own.hint("merge"), ["sample_id", "dst"]).groupBy("sample_id", F.col("src").alias("cell_id"), "cluster").agg(F.count("*").alias("n"))
    share = by_cell.groupBy("sample_id", "cluster").agg(F.sum("n").alias("n"))
    share = share.select("sample_id", "cluster", (F.col("n") / F.sum("n").over(Window.partitionBy("sample_id"))).alias("share"))
    if n_perm:
        units = cells.select("sample_id", F.col("cell_id").alias("id"), F.col("cell_type").alias("value"))
        met = dealt_counts(units, by_cell.select("sample_id", F.col("cell_id").alias("id"), F.col("cluster").alias("other"), F.col("n").alias("m")), n_perm + 1, seed)
        met = met.select("perm", "sample_id", F.col("value").alias("cell_type"), F.col("other").alias("cluster"), "n")
    else:
        typed = cells.select(F.lit(0).alias("perm"), "sample_id", "cell_id", "cell_type")
        met = typed.hint("merge").join(by_cell, ["sample_id", "cell_id"]).groupBy("perm", "sample_id", "cell_type", "cluster").agg(F.sum("n").alias("n"))
    seen = met.groupBy("perm", "cell_type", "cluster").agg(F.sum("n").alias("observed"))
    target = met.groupBy("perm", "sample_id", "cell_type").agg(F.sum("n").alias("m"))
    expected = target.join(share, "sample_id").groupBy("perm", "cell_type", "cluster").agg(F.sum(F.col("m") * F.col("share")).alias("expected"))
    out = expected.join(seen, ["perm", "cell_type", "cluster"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)).cast("double"))
    out = out.withColumn("log2", F.log2((F.col("observed") + eps) / (F.col("expected") + eps)))
    real = out.where("perm = 0").drop("perm")
    if not n_perm:
        return real.select("cell_type", "cluster", "observed", "expected", "log2")
    null = out.where("perm > 0").select("cell_type", "cluster", F.round("log2", 9).alias("_l"))
    far = real.join(null, ["cell_type", "cluster"], "left").groupBy("cell_type", "cluster", "observed", "expected", "log2").agg(F.sum((F.abs("_l") >= F.abs(F.round("log2", 9))).cast("long")).alias("_far"))
    far = far.withColumn("p", (F.coalesce("_far", F.lit(0)) + 1) / F.lit(n_perm + 1.0)).drop("_far")
    return benjamini_hochberg(far, "p")


def enrichment_by_sample(cells: DataFrame, labels: DataFrame, cross: DataFrame, k: int, eps: float = EPS) -> DataFrame:
    """(sample_id, cell_type, cluster, observed, expected, log2) within each sample, for all its cell types and the clusters 0 to k - 1; samples without edges have none."""
    own = labels.where((F.col("label") >= 0) & (F.col("label") < k)).select("sample_id", F.col("id").alias("dst"), F.col("label").cast("int").alias("cluster"))
    typed = cells.select("sample_id", F.col("cell_id").alias("src"), "cell_type")
    met = cross.join(own, ["sample_id", "dst"]).join(typed, ["sample_id", "src"]).groupBy("sample_id", "cell_type", "cluster").agg(F.count("*").alias("n"))
    side = F.broadcast(cells.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster")))
    grid = typed.select("sample_id", "cell_type").distinct().join(met.select("sample_id").distinct(), "sample_id").crossJoin(side)
    full = grid.join(met, ["sample_id", "cell_type", "cluster"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = lambda *by: F.sum("n").over(Window.partitionBy("sample_id", *by))
    full = full.withColumn("expected", total("cluster") / total() * total("cell_type"))
    return full.select("sample_id", "cell_type", "cluster", F.col("n").cast("double").alias("observed"), "expected", F.log2((F.col("n") + eps) / (F.col("expected") + eps)).alias("log2"))


def interaction_test(cells: DataFrame, labels: DataFrame, cross: DataFrame, n: int, level: float = 0.05, seed: int = 0) -> DataFrame:
    """(cell_type, label, n, p_enriched, p_depleted, call) with patch labels dealt anew within samples; call is -1 (wins), 1 or 0; no one is added."""
    typed = cross.join(cells.select("sample_id", F.col("cell_id").alias("src"), "cell_type"), ["sample_id", "src"]).groupBy("sample_id", F.col("dst").alias("id"), "cell_type").agg(F.count("*").alias("m"))
    counts = dealt_counts(labels.select("sample_id", "id", F.col("label").alias("value")), typed.withColumnRenamed("cell_type", "other"), n + 1, seed)
    counts = counts.groupBy("perm", F.col("other").alias("cell_type"), F.col("value").alias("label")).agg(F.sum("n").alias("n"))
    grid = typed.select("cell_type").distinct().crossJoin(F.broadcast(labels.select("label").distinct())).crossJoin(F.broadcast(cells.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("perm"))))
    full = grid.join(counts, ["perm", "cell_type", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    real = full.where("perm = 0").select("cell_type", "label", F.col("n").alias("_n"))
    out = full.where("perm > 0").join(real, ["cell_type", "label"]).groupBy("cell_type", "label").agg(F.first("_n").alias("n"), F.avg((F.col("n") >= F.col("_n")).cast("double")).alias("p_enriched"), F.avg((F.col("n") <= F.col("_n")).cast("double")).alias("p_depleted"))
    return out.withColumn("call", F.when(F.col("p_depleted") < level, -1).when(F.col("p_enriched") < level, 1).otherwise(0))


def cooccurrence_test(labels: DataFrame, edges: DataFrame, groups: DataFrame, a: str, b: str, k: int, n: int, seed: int = 0, eps: float = EPS) -> DataFrame:
    """(i, j, delta, p, p_fdr) of the difference of log2 matrices of two groups of samples, by dealing samples anew; i <= j."""
    own = labels.where((F.col("label") >= 0) & (F.col("label") < k))
    of = lambda end: own.select("sample_id", F.col("id").alias(end), F.col("label").cast("int").alias(f"_{end}"))
    pairs = edges.select("sample_id", "src", "dst").join(of("src"), ["sample_id", "src"]).join(of("dst"), ["sample_id", "dst"])
    pairs = pairs.groupBy("sample_id", F.least("_src", "_dst").alias("i"), F.greatest("_src", "_dst").alias("j")).agg(F.count("*").alias("n"))
    nodes = own.groupBy("sample_id", F.col("label").cast("int").alias("i")).agg(F.count("*").alias("m"))
    dealt = permuted(groups.where(F.col("grp").isin(a, b)).select(F.lit(0).alias("pool"), "sample_id", "grp"), "sample_id", "grp", n + 1, seed, "pool").drop("pool")
    seen = dealt.join(pairs, "sample_id").groupBy("perm", "grp", "i", "j").agg(F.sum("n").alias("n"))
    total = seen.groupBy("perm", "grp").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(2 * F.col("n"))).alias("total"))
    share = dealt.join(nodes, "sample_id").groupBy("perm", "grp", "i").agg(F.sum("m").alias("m"))
    share = share.withColumn("p", F.col("m") / F.sum("m").over(Window.partitionBy("perm", "grp"))).drop("m")
    side = labels.sparkSession.range(k).select(F.col("id").cast("int").alias("i"))
    grid = dealt.select("perm", "grp").distinct().crossJoin(F.broadcast(side)).crossJoin(F.broadcast(side.withColumnRenamed("i", "j"))).where("i <= j")
    full = grid.join(seen, ["perm", "grp", "i", "j"], "left").join(total, ["perm", "grp"], "left").join(share, ["perm", "grp", "i"], "left").withColumnRenamed("p", "p_i")
    full = full.join(share.select("perm", "grp", F.col("i").alias("j"), F.col("p").alias("p_j")), ["perm", "grp", "j"], "left")
    expected = F.col("total") * F.col("p_i") * F.col("p_j")
    value = F.when(expected > 0, F.log2((F.coalesce("n", F.lit(0)) + eps) / expected)).otherwise(0.0)
    delta = full.withColumn("_v", value).groupBy("perm", "i", "j").agg(F.round(F.sum(F.when(F.col("grp") == a, F.col("_v")).otherwise(-F.col("_v"))), 9).alias("delta"))
    real = delta.where("perm = 0").select("i", "j", F.col("delta").alias("_d"))
    out = delta.where("perm > 0").join(real, ["i", "j"]).groupBy("i", "j").agg(F.first("_d").alias("delta"), ((F.sum((F.abs("delta") >= F.abs("_d")).cast("long")) + 1) / F.lit(n + 1.0)).alias("p"))
    return benjamini_hochberg(out, "p")


def top_cluster(enriched: DataFrame, direction: str = "positive", level: float = 0.05) -> DataFrame:
    """Each cell type's significant cluster of largest (or smallest) log2; ties go to the smaller cluster."""
    sign = F.col("log2") > 0 if direction == "positive" else F.col("log2") < 0
    order = F.desc("log2") if direction == "positive" else F.asc("log2")
    out = enriched.where(sign & (F.col("p_fdr") < level))
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("cell_type").orderBy(order, "cluster"))).where("_r = 1").drop("_r")


def centroids(patches: DataFrame, markers: list[str], k: int, eps: float = EPS) -> DataFrame:
    """(cluster, marker, mean, n, z): means by cluster (0 if empty) and their z-scores across clusters."""
    long = patches.where((F.col("ecm_cluster") >= 0) & (F.col("ecm_cluster") < k)).select(F.col("ecm_cluster").cast("int").alias("cluster"), F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), F.col(m).alias("v")) for m in markers])).alias("f")).select("cluster", "f.*")
    got = long.groupBy("cluster", "marker").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    spark = patches.sparkSession
    grid = spark.range(k).select(F.col("id").cast("int").alias("cluster")).crossJoin(spark.createDataFrame([(m,) for m in markers], "marker string"))
    full = grid.join(got, ["cluster", "marker"], "left").withColumns({"mean": F.coalesce("mean", F.lit(0.0)), "n": F.coalesce("n", F.lit(0))})
    w = Window.partitionBy("marker")
    return full.withColumn("z", (F.col("mean") - F.avg("mean").over(w)) / (F.stddev_pop("mean").over(w) + eps))


def niche(cells: DataFrame, patches: DataFrame, cross: DataFrame, cell_type: str, cluster: int, markers: list[str]) -> DataFrame:
    """(marker, mean, share): means over edges of the patches' features, not below 0, around one cell type and cluster."""
    own = cross.join(cells.where(F.col("cell_type") == cell_type).select("sample_id", F.col("cell_id").alias("src")), ["sample_id", "src"], "left_semi")
    met = own.join(patches.where(F.col("ecm_cluster") == cluster).select("sample_id", F.col("patch_id").alias("dst"), *markers), ["sample_id", "dst"])
    row = met.agg(*[F.avg(F.greatest(F.col(m), F.lit(0.0))).alias(m) for m in markers])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), F.col(m).alias("mean")) for m in markers])).alias("f")).select("f.*")
    total = F.sum("mean").over(Window.partitionBy())
    return out.withColumn("share", F.when(total > 0, F.col("mean") / total).otherwise(0.0))


def grouped_summary(results: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """(by, metric, mean, sd, n) of the non-null values; a null group is a group."""
    long = results.unpivot([by], metrics, "metric", "v")
    return long.groupBy(by, "metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("v").alias("n"))


def representatives(scores: DataFrame, selector: str = "median", least: float | None = None) -> DataFrame:
    """Each group's sample of upper median, largest, smallest or first score; a missing score is 0, ties go by sample.

    ``least`` drops smaller scores, unless that leaves a group empty.
    """
    df = scores.select("grp", "sample_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    if least is not None:
        any_ = F.max((F.col("score") >= least).cast("int")).over(Window.partitionBy("grp"))
        df = df.withColumn("_any", any_).where((F.col("score") >= least) | (F.col("_any") == 0)).drop("_any")
    order = ["sample_id"] if selector == "first" else ["score", "sample_id"]
    w = Window.partitionBy("grp")
    df = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    pick = {"median": F.expr("_n div 2 + 1"), "max": F.col("_n"), "min": F.lit(1), "first": F.lit(1)}[selector]
    return df.where(F.col("_r") == pick).drop("_r", "_n")


def partition_scores(pairs: DataFrame) -> DataFrame:
    """(macro_f1, ari) of ``pairs(label, truth)``: labels map to their most frequent class (the smallest on ties)."""
    table = pairs.groupBy("label", "truth").agg(F.count("*").alias("n"))
    best = table.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "truth"))).where("_r = 1").select("label", F.col("truth").alias("mapped"))
    cells = table.join(best, "label").groupBy("mapped", "truth").agg(F.sum("n").alias("n"))
    hit = cells.where("mapped = truth").select(F.col("truth").alias("c"), F.col("n").alias("tp"))
    called, true = (cells.groupBy(F.col(x).alias("c")).agg(F.sum("n").alias(y)) for x, y in (("mapped", "called"), ("truth", "true")))
    f1 = true.join(called, "c", "full").join(hit, "c", "left").select((2 * F.coalesce("tp", F.lit(0)) / (F.coalesce("called", F.lit(0)) + F.coalesce("true", F.lit(0)))).alias("f1")).agg(F.avg("f1").alias("macro_f1"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    a = table.groupBy("label").agg(F.sum("n").alias("n")).agg(two("n").alias("a"))
    b = table.groupBy("truth").agg(F.sum("n").alias("n")).agg(two("n").alias("b"))
    whole = table.agg(two("n").alias("ab"), F.sum("n").alias("n"))
    ari = whole.crossJoin(a).crossJoin(b).withColumn("e", F.col("a") * F.col("b") / (F.col("n") * (F.col("n") - 1) / 2.0)).withColumn("m", (F.col("a") + F.col("b")) / 2)
    ari = ari.select(F.when(F.col("m") == F.col("e"), 1.0).otherwise((F.col("ab") - F.col("e")) / (F.col("m") - F.col("e"))).alias("ari"))
    return f1.crossJoin(ari)


def curve_points(scored: DataFrame) -> DataFrame:
    """(sample_id, score, tp, fp, p, n) at each distinct score of ``scored(sample_id, score, label)``, highest first."""
    ties = scored.groupBy("sample_id", "score").agg(F.sum("label").alias("_t"), F.count("*").alias("_c"))
    w = Window.partitionBy("sample_id").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("sample_id")
    return ties.select("sample_id", "score", F.sum("_t").over(w).alias("tp"), F.sum(F.col("_c") - F.col("_t")).over(w).alias("fp"), F.sum("_t").over(all_).alias("p"), F.sum(F.col("_c") - F.col("_t")).over(all_).alias("n"))


def curve_areas(scored: DataFrame) -> DataFrame:
    """(sample_id, roc_auc, average_precision); null where a class is missing."""
    points = curve_points(scored)
    w = Window.partitionBy("sample_id").orderBy(F.desc("score"))
    points = points.withColumns({"_tp": F.coalesce(F.lag("tp").over(w), F.lit(0)), "_fp": F.coalesce(F.lag("fp").over(w), F.lit(0))})
    out = points.groupBy("sample_id").agg(
        F.sum((F.col("fp") - F.col("_fp")) * (F.col("tp") + F.col("_tp")) / 2.0).alias("_a"), F.sum((F.col("tp") - F.col("_tp")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_b"), F.first("p").alias("p"), F.first("n").alias("n")
    )
    fine = (F.col("p") > 0) & (F.col("n") > 0)
    return out.select("sample_id", F.when(fine, F.col("_a") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("roc_auc"), F.when(fine, F.col("_b") / F.nullif(F.col("p"), F.lit(0))).alias("average_precision"))


def mean_curve(points: DataFrame, steps: int = 201) -> DataFrame:
    """(x, y): the mean over samples of curves ``points(sample_id, x, y)``, each interpolated at ``steps`` even places of [0, 1].

    A curve has its largest y at each x, and its end values beyond its ends.
    """
    own = points.groupBy("sample_id", "x").agg(F.max("y").alias("y"))
    grid = own.select("sample_id").distinct().crossJoin(F.broadcast(points.sparkSession.range(steps).select((F.col("id") / (steps - 1.0)).alias("x"))))
    # A grid row stands between the points at or before it and at or after it.
    all_ = own.select("sample_id", "x", "y", F.lit(0).alias("_g"), F.col("x").alias("_x")).unionByName(grid.select("sample_id", "x", F.lit(None).cast("double").alias("y"), F.lit(1).alias("_g"), F.lit(None).cast("double").alias("_x")))
    back = Window.partitionBy("sample_id").orderBy("x", "_g").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("sample_id").orderBy(F.desc("x"), "_g").rowsBetween(Window.unboundedPreceding, 0)
    all_ = all_.withColumns({"x0": F.last("_x", True).over(back), "y0": F.last("y", True).over(back), "x1": F.last("_x", True).over(ahead), "y1": F.last("y", True).over(ahead)}).where("_g = 1")
    inner = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0))
    return all_.select("x", F.when(F.col("x0").isNull(), F.col("y1")).when(F.col("x1").isNull() | (F.col("x1") == F.col("x0")), F.col("y0")).otherwise(inner).alias("y")).groupBy("x").agg(F.avg("y").alias("y"))


def flag_rate(scored: DataFrame, recall: float = 0.9) -> DataFrame:
    """(sample_id, threshold, flagged): the share of negatives at or over the positives' (1 - recall) quantile; without positives none are."""
    cut = scored.where("label = 1").groupBy("sample_id").agg(F.percentile("score", F.lit(1 - recall)).alias("threshold"))
    joined = scored.join(cut, "sample_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))
    return joined.groupBy("sample_id", "threshold").agg(F.avg(F.when(F.col("label") == 0, (F.col("score") >= F.col("threshold")).cast("double"))).alias("flagged"))


def group_folds(groups: DataFrame, n: int = 2) -> DataFrame:
    """(label, grp, fold): the groups of each class, in their order, dealt to n folds in turn."""
    w = Window.partitionBy("label").orderBy("grp")
    return groups.select("label", "grp").distinct().withColumn("fold", F.pmod(F.row_number().over(w) - 1, F.lit(n)))


def class_probabilities(rows: DataFrame) -> DataFrame:
    """(unit, cluster, mean, sd, n_graphs, n_nodes): nodes' p averaged in graphs, graphs' in units; one graph has sd 0."""
    graphs = rows.groupBy("unit", "graph", "cluster").agg(F.avg("p").alias("p"), F.count("*").alias("m"))
    return graphs.groupBy("unit", "cluster").agg(F.avg("p").alias("mean"), F.coalesce(F.stddev_samp("p"), F.lit(0.0)).alias("sd"), F.count("*").alias("n_graphs"), F.sum("m").alias("n_nodes"))


def reconstruction(rows: DataFrame) -> DataFrame:
    """Per sample of ``rows(sample_id, pristine, corrupted, denoised, is_artifact)``: accuracies, recovery, precision, relabel rate; null without cases."""
    yes = lambda cond: F.avg(cond.cast("double"))
    art, moved = F.col("is_artifact"), F.col("denoised") != F.col("corrupted")
    right = F.col("denoised") == F.col("pristine")
    return rows.groupBy("sample_id").agg(
        yes(F.col("corrupted") == F.col("pristine")).alias("accuracy_before"), yes(right).alias("accuracy_after"), yes(F.when(art, right)).alias("recovery"), yes(F.when(moved, right)).alias("precision"), yes(F.when(~art, moved)).alias("pristine_relabelled")
    )
