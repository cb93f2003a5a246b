"""Normalisation of a column within partitions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from matrixweave.plans.ranges import from_on, in_ranges, ranges_after, with_running_sums
from matrixweave.plans.scratch import written


def min_max(v: str, *by: str) -> Column:
    """(v - min) / (max - min); 0 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(v).over(w), F.max(v).over(w)
    return F.when(high > low, (F.col(v) - low) / (high - low)).otherwise(F.when(F.col(v).isNotNull(), 0.0))


def z_score(v: str, *by: str, eps: float = 0.0) -> Column:
    """(v - mean) / population deviation; a deviation of 0 counts as 1, unless ``eps`` is added to all."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(v).over(w)
    return (F.col(v) - F.avg(v).over(w)) / (sd + F.lit(eps) if eps else F.when(sd > 0, sd).otherwise(1.0))


def arcsinh_clip(v: str, *by: str, cofactor: float = 1.0, share: float = 0.995) -> Column:
    """asinh(v / cofactor) over its quantile, if that is above 0, within [0, 1]."""
    scaled = F.asinh(F.col(v) / F.lit(float(cofactor)))
    top = F.percentile(scaled, F.lit(share)).over(Window.partitionBy(*by))
    return F.least(F.greatest(F.when(top > 0, scaled / top).otherwise(scaled), F.lit(0.0)), F.lit(1.0))


def benjamini_hochberg(df, p: str, *by: str):
    """``df`` with p_fdr: p * n / rank, made non-decreasing in p, at most 1; tied p share a value, null p stay null.

    A group of ``by``, or all rows without it, are ordered in one task: for tables as small as
    their parameters.  ``benjamini_hochberg_ranged`` takes any number of rows.
    """
    rank = F.max("_rank").over(Window.partitionBy(*by, p)) if by else F.max("_rank").over(Window.partitionBy(p))
    valid = F.col(p).isNotNull()
    part = Window.partitionBy(*by, valid)
    out = df.withColumn("_rank", F.row_number().over(part.orderBy(p))).withColumn("_n", F.count(p).over(part)).withColumn("_rank", rank)
    raw = F.col(p) * F.col("_n") / F.col("_rank")
    low = F.min(raw).over(part.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    # Ties: the smallest of the block, which its last row has.
    low = F.when(valid, F.least(low, F.lit(1.0)))
    out = out.withColumn("_low", low)
    return out.withColumn("p_fdr", F.min("_low").over(Window.partitionBy(*by, p))).drop("_rank", "_n", "_low")


def benjamini_hochberg_ranged(df, p: str):
    """``benjamini_hochberg`` of all rows, by ranges of the distinct p: no task orders them all."""
    own = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    ranked = with_running_sums(in_ranges(own, "_p", "p-values"), "_p", _rank=F.col("_n"))
    ranked = written(ranked.select("_part", "_p", (F.col("_p") * F.col("_rank_all") / F.col("_rank")).alias("_raw")), "p-ranked")
    after = ranked.groupBy("_part").agg(F.min("_raw").alias("_least")).select("_part", F.min("_least").over(ranges_after()).alias("_after"))
    low = F.least(F.min("_raw").over(from_on("_p")), F.col("_after"), F.lit(1.0))
    found = ranked.join(F.broadcast(after), "_part").select("_p", low.alias("p_fdr"))
    return df.join(found, df[p] == found["_p"], "left").drop(found["_p"])
