"""Label denoising: a classifier of patch labels from what lies around, held-out evaluation, and ablation of its contexts."""

from __future__ import annotations

import functools

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixweave.operators import stats
from matrixweave.operators.spatial import symmetric
from matrixweave.plans.scratch import written

CONTEXTS = ("cell", "ecm", "joint", "prior")
EPS = 1e-9


def features(patches: DataFrame, cells: DataFrame, cross: DataFrame, lattice: DataFrame, types: list[str], k: int, context: str = "joint") -> DataFrame:
    """(sample_id, id, label, x array): shares of the neighbouring cells' types, of the neighbouring patches' labels, or both; zeros where there are none.

    ``patches(sample_id, id, label)``, ``cells(sample_id, cell_id, cell_type)``.  Each part adds up to 1.
    """
    parts = []
    if context in ("cell", "joint"):
        met = cross.select("sample_id", "src", F.col("dst").alias("id")).join(cells.select("sample_id", F.col("cell_id").alias("src"), "cell_type"), ["sample_id", "src"])
        counts = met.groupBy("sample_id", "id").agg(F.array(*[F.sum((F.col("cell_type") == t).cast("double")) for t in types]).alias("_cell"))
        parts.append((counts, "_cell", len(types)))
    if context in ("ecm", "joint"):
        near = symmetric(lattice.select("sample_id", "src", "dst")).join(patches.select("sample_id", F.col("id").alias("dst"), F.col("label").alias("_l")), ["sample_id", "dst"]).where((F.col("_l") >= 0) & (F.col("_l") < k))
        counts = near.groupBy("sample_id", F.col("src").alias("id")).agg(F.array(*[F.sum((F.col("_l") == c).cast("double")) for c in range(k)]).alias("_ecm"))
        parts.append((counts, "_ecm", k))
    out = patches.select("sample_id", "id", "label")
    for counts, name, n in parts:
        total = F.aggregate(name, F.lit(0.0), lambda s, x: s + x)
        counts = counts.withColumn("_t", total).select("sample_id", "id", F.transform(name, lambda x: F.when(F.col("_t") > 0, x / F.col("_t")).otherwise(0.0)).alias(name))
        out = out.join(counts, ["sample_id", "id"], "left").withColumn(name, F.coalesce(name, F.array_repeat(F.lit(0.0), n)))
    return out.select("sample_id", "id", "label", F.concat(*[p[1] for p in parts]).alias("x"))


def fit(rows: DataFrame, max_iter: int = 100):
    """A multinomial classifier of signal labels; the penalty is that of strength 1 on the summed loss."""
    own = rows.where("label >= 0").select(F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))
    n = own.count()
    if own.select("label").distinct().count() < 2:
        raise ValueError("the training patches have fewer than two signal labels")
    return LogisticRegression(family="multinomial", regParam=1.0 / n, standardization=False, maxIter=max_iter).fit(own)


def score(model, rows: DataFrame) -> DataFrame:
    """``rows`` plus p_actual (EPS if unseen), predicted and anomaly: -ln p_actual between the sample's extremes over signal; background has anomaly 0 and keeps its label."""
    found = model.transform(rows.withColumn("features", array_to_vector("x"))).withColumn("_p", vector_to_array("probability"))
    seen = (F.col("label") >= 0) & (F.col("label") < F.size("_p"))
    p = F.when(seen, F.greatest(F.element_at("_p", F.greatest(F.col("label").cast("int"), F.lit(0)) + 1), F.lit(EPS))).otherwise(EPS)
    best = F.array_position("_p", F.array_max("_p")).cast("int") - 1
    out = found.withColumns({"p_actual": p, "predicted": F.when(F.col("label") >= 0, best).otherwise(F.col("label"))}).withColumn("raw", F.when(F.col("label") >= 0, -F.log("p_actual")))
    w = Window.partitionBy("sample_id")
    low, high = F.min("raw").over(w), F.max("raw").over(w)
    out = out.withColumn("anomaly", F.coalesce(F.when(high > low, (F.col("raw") - low) / (high - low)), F.lit(0.0)))
    return out.drop("features", "rawPrediction", "probability", "prediction", "_p")


def held_out(pristine: DataFrame, corrupted: DataFrame, build, folds: DataFrame, max_iter: int = 100) -> DataFrame:
    """(fold, sample_id, id, label, truth, raw, anomaly, predicted) of every sample by a model of the other folds.

    ``build(patches)`` makes feature rows; ``folds(sample_id, fold)`` holds out whole
    groups.  ``pristine`` rows train, ``corrupted(…, truth)`` rows of the fold are scored
    with features of the corrupted labels.
    """
    train, test = written(build(pristine), "train"), written(build(corrupted), "test")
    names = sorted(r[0] for r in folds.select("fold").distinct().collect())  # one model a fold
    out = []
    for name in names:
        own = folds.where(F.col("fold") == name).select("sample_id")
        model = fit(train.join(F.broadcast(own), "sample_id", "left_anti"), max_iter)
        scored = score(model, test.join(F.broadcast(own), "sample_id", "left_semi"))
        out.append(written(scored.select(F.lit(name).alias("fold"), "sample_id", "id", "label", "raw", "anomaly", "predicted"), "fold"))
    return functools.reduce(DataFrame.unionByName, out).join(corrupted.select("sample_id", "id", "truth"), ["sample_id", "id"])


def areas(scored: DataFrame) -> DataFrame:
    """(fold, roc_auc, average_precision) of signal patches."""
    own = scored.where("label >= 0").select(F.col("fold").alias("sample_id"), F.col("raw").alias("score"), F.col("truth").cast("int").alias("label"))
    return stats.curve_areas(own).withColumnRenamed("sample_id", "fold")


def ablation(pristine: DataFrame, corrupted: DataFrame, builders: dict, folds: DataFrame) -> DataFrame:
    """(model, fold, roc_auc, average_precision) for each context over the same folds; ``prior`` needs no features."""
    from matrixweave.operators.patches import prior_scores

    out = []
    for name, build in builders.items():
        out.append(areas(held_out(pristine, corrupted, build, folds)).withColumn("model", F.lit(name)))
    names = sorted(r[0] for r in folds.select("fold").distinct().collect())
    prior = []
    for name in names:
        own = folds.where(F.col("fold") == name).select("sample_id")
        rest = pristine.join(F.broadcast(own), "sample_id", "left_anti")
        prior.append(prior_scores(rest.select("label"), corrupted.join(F.broadcast(own), "sample_id", "left_semi")).select(F.lit(name).alias("fold"), "label", F.col("score").alias("raw"), "truth"))
    out.append(areas(functools.reduce(DataFrame.unionByName, prior)).withColumn("model", F.lit("prior")))
    return functools.reduce(DataFrame.unionByName, out).select("model", "fold", "roc_auc", "average_precision")


def summary(results: DataFrame, by: str = "model", metric: str = "roc_auc") -> DataFrame:
    """(by, mean, sd, least, most, n) of the folds' values."""
    return results.groupBy(by).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.min(metric).alias("least"), F.max(metric).alias("most"), F.count(metric).alias("n"))
