"""Clusters of feature vectors, their quality, and the choice of their number."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixweave.operators import graph, stats
from matrixweave.plans.scratch import written

SEED, SAMPLE = 42, 8000


def standardised(df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with z, its features as a vector of mean 0 and population deviation 1 (0 stays 0)."""
    m = df.agg(*[f(c).alias(f"_{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(m))  # one row
    z = [F.when(F.col(f"_s{i}") > 0, (F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}")).otherwise(0.0).alias(f"_z{i}") for i, c in enumerate(features)]
    out = out.select(*df.columns, *z)
    return VectorAssembler(inputCols=[f"_z{i}" for i in range(len(features))], outputCol="z").transform(out).select(*df.columns, "z")


def kmeans(df: DataFrame, features: list[str], k: int, seed: int = SEED) -> DataFrame:
    """``df`` with cluster, 0 to k - 1 by size (largest first), of standardised features."""
    z = standardised(df, features)
    found = KMeans(k=k, seed=seed, featuresCol="z", predictionCol="_c", maxIter=50).fit(z).transform(z)
    sizes = found.groupBy("_c").count()
    rank = sizes.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("count"), "_c")) - 1).select("_c", "cluster")
    return found.join(F.broadcast(rank), "_c").select(*df.columns, "z", "cluster")


def silhouette(clustered: DataFrame, id_col: str, sample: int = SAMPLE) -> DataFrame:
    """(silhouette): mean of (b - a) / max(a, b) with Euclidean distances over at most ``sample`` rows, picked by hash; single members score 0.

    The sample bounds the pairs; it is the statistic's own definition.
    """
    from pyspark.ml.functions import vector_to_array

    own = clustered.select(F.col(id_col).alias("id"), "cluster", vector_to_array("z").alias("z")).orderBy(F.xxhash64("id"), "id").limit(sample)
    own = written(own, "silhouette")
    d = F.sqrt(F.aggregate(F.zip_with("z", "_z", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    # The sample's other rows come as one row a cluster and block.
    packs = own.groupBy("cluster", F.pmod(F.xxhash64("id"), F.lit(16)).alias("_b")).agg(F.collect_list(F.struct("id", "z")).alias("_p")).select(F.col("cluster").alias("_c"), "_p")
    pairs = own.crossJoin(F.broadcast(packs)).withColumn("_q", F.explode("_p")).where("id <> _q.id").select("id", "cluster", "_c", "z", F.col("_q.z").alias("_z"))
    mean = pairs.groupBy("id", "cluster", "_c").agg(F.avg(d).alias("d"))
    s = mean.groupBy("id", "cluster").agg(F.min(F.when(F.col("_c") != F.col("cluster"), F.col("d"))).alias("b"), F.max(F.when(F.col("_c") == F.col("cluster"), F.col("d"))).alias("a"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0))
    return s.agg(F.avg(value).alias("silhouette"))


def calinski_harabasz(clustered: DataFrame) -> DataFrame:
    """(calinski_harabasz): between-cluster over within-cluster variance, from sums of each cluster."""
    from pyspark.ml.functions import vector_to_array

    long = clustered.select("cluster", F.posexplode(vector_to_array("z")).alias("k", "v"))
    sums = long.groupBy("cluster", "k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") ** 2).alias("q"))
    all_ = Window.partitionBy("k")
    parts = sums.withColumns({"_m": F.sum("s").over(all_) / F.sum("n").over(all_)})
    out = parts.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("_m")) ** 2).alias("b"), F.sum(F.col("q") - F.col("s") ** 2 / F.col("n")).alias("w"), F.countDistinct("cluster").alias("c"), (F.sum("n") / F.countDistinct("k")).alias("n"))
    return out.select(((F.col("b") / (F.col("c") - 1)) / (F.col("w") / (F.col("n") - F.col("c")))).alias("calinski_harabasz"))


def select_k(df: DataFrame, features: list[str], id_col: str, ks: range = range(2, 7), seeds: int = 3) -> DataFrame:
    """(k, silhouette, stability, best): scores of k-means by k; stability is the mean ARI of other seeds with the first."""
    spark, rows = df.sparkSession, []
    for k in ks:
        runs = [written(kmeans(df, features, k, SEED + s).select(id_col, "z", "cluster"), "kmeans") for s in range(seeds)]
        score = silhouette(runs[0], id_col).first()[0]
        agree = [stats.partition_scores(runs[0].select(id_col, F.col("cluster").alias("label")).join(r.select(id_col, F.col("cluster").alias("truth")), id_col)).first()["ari"] for r in runs[1:]]
        rows.append((k, float(score), float(sum(agree) / len(agree)) if agree else 1.0))
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], "k int, silhouette double, stability double, best boolean")


def select_domains(df: DataFrame, features: list[str], edges: DataFrame, ks: range = range(2, 9), eps: float = 1e-9) -> DataFrame:
    """(k, modularity, coherence, score, best) of k-means domains over ``edges``; score adds both z-scores over k."""
    spark, rows = df.sparkSession, []
    for k in ks:
        labels = written(kmeans(df, features, k).select("sample_id", "id", F.col("cluster").alias("label")), "domains")
        q = graph.modularity(labels, edges).agg(F.avg("modularity")).first()[0]
        c = graph.coherence(labels, edges).groupBy("sample_id").agg(F.min("coherence").alias("c")).agg(F.avg("c")).first()[0]
        rows.append((k, float(q or 0), float(c or 0)))
    out = spark.createDataFrame(rows, "k int, modularity double, coherence double")
    w = Window.partitionBy()
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + eps)
    out = out.withColumn("score", z("modularity") + z("coherence"))
    return out.withColumn("best", F.row_number().over(w.orderBy(F.desc("score"), "k")) == 1)


def neighbourhoods(cells: DataFrame, edges: DataFrame, k: int = 4) -> DataFrame:
    """``cells(sample_id, id, cell_type)`` with counts of neighbours' types and their k-means cluster."""
    from matrixweave.operators.spatial import symmetric

    near = symmetric(edges.select("sample_id", "src", "dst")).join(cells.select("sample_id", F.col("id").alias("dst"), "cell_type"), ["sample_id", "dst"])
    types = sorted(r[0] for r in cells.select("cell_type").distinct().collect())  # the vocabulary of cell types
    wide = near.groupBy("sample_id", F.col("src").alias("id")).pivot("cell_type", types).count()
    full = cells.select("sample_id", "id").join(wide, ["sample_id", "id"], "left").fillna(0, types)
    full = full.select("sample_id", "id", *[F.col(f"`{t}`").cast("double").alias(f"n{i}") for i, t in enumerate(types)])
    return kmeans(full, [f"n{i}" for i in range(len(types))], k).drop("z")

