"""Spatial joins: pairs within a radius, nearest neighbours, lattices, and transfer of values.

Pairs meet through grid buckets: one side goes to its own bucket, the other to the nine
around it, so that a pair meets once and no join compares all rows.  All functions work
on every sample at once; ``sample_id`` is part of each key.

Spark takes a table whose rows have been multiplied for as large as it was before, and would
broadcast it from the driver; such joins are sorted and merged.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrixweave.plans.scratch import written

AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _bucket(v: str, size: Column) -> Column:
    return F.floor(F.col(v) / size).cast("long")


def _spread(df: DataFrame, size: Column) -> DataFrame:
    """Each row in the nine buckets around its own."""
    around = F.explode(F.array(*[F.struct((_bucket("y", size) + dy).alias("by"), (_bucket("x", size) + dx).alias("bx")) for dy, dx in AROUND]))
    return df.withColumn("_b", around).select("*", "_b.by", "_b.bx").drop("_b")


def range_join(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(sample_id, src, dst, d) of rows of ``a(sample_id, id, x, y)`` and ``b`` at most ``radius`` apart."""
    size = F.lit(float(radius))
    left = a.select("sample_id", F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), _bucket("y", size).alias("by"), _bucket("x", size).alias("bx"))
    right = _spread(b.select("sample_id", F.col("id").alias("dst"), "x", "y"), size)
    d2 = (F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2
    return left.join(right.hint("merge"), ["sample_id", "by", "bx"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).select("sample_id", "src", "dst", F.sqrt("d2").alias("d"))


def radius_edges(points: DataFrame, radius: float) -> DataFrame:
    """Each pair of one sample at most ``radius`` apart, once, src < dst."""
    return range_join(points, points, radius).where("src < dst")


def nearest(a: DataFrame, b: DataFrame, k: int, *, own: bool = False, cap: float | None = None, start: float | None = None) -> DataFrame:
    """(sample_id, src, dst, d, rank) of the k rows of ``b`` nearest to each row of ``a``; ties go to the smaller id.

    Rounds of growing buckets: a place is settled once its k-th candidate is no farther
    than the bucket's side, for then no row outside the nine buckets can be nearer.
    The others go on with buckets twice the size; buckets as large as the sample's
    extent settle all.  Rows of ``a`` at one place are searched for once, and of rows of
    ``b`` at one place only the smallest ids can be neighbours, so that rows which
    coincide do not meet each other.  ``own``: both sides are the same rows, and a row is
    not its own neighbour.  ``cap``: neighbours farther away are dropped.
    """
    most = k + own  # a row's own place holds the row too
    both = b.select("sample_id", "x", "y", F.lit(1).alias("_b")).unionByName(a.select("sample_id", "x", "y", F.lit(0).alias("_b")))
    extent = both.groupBy("sample_id").agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("_extent"), F.greatest(F.sum("_b"), F.lit(1)).alias("_n"))
    # Buckets that hold about k rows on average, one size a sample.
    first = F.lit(float(start)) if start else F.col("_extent") * F.sqrt(F.lit(float(k)) / F.col("_n")) / 2
    extent = written(extent.select("sample_id", "_extent", first.alias("_first")), "extent")
    place = Window.partitionBy("sample_id", "x", "y").orderBy("dst")
    side = b.select("sample_id", F.col("id").alias("dst"), "x", "y").withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= most).drop("_r")
    side = written(side, "places")
    if not start:
        extent = _crowded(side, extent, 2 * most)
    side = side.join(extent, "sample_id")
    left, done = a.select("sample_id", F.col("x").alias("ax"), F.col("y").alias("ay")).distinct().join(extent, "sample_id"), []
    at = ["sample_id", "ax", "ay"]
    rounds = 0
    while True:
        own_size = F.col("_first") * float(2**rounds)
        right = _spread(side.withColumn("_size", own_size), F.col("_size")).select("sample_id", "dst", "x", "y", "by", "bx")
        here = left.withColumn("_size", own_size)
        probe = here.select(*at, "_size", "_extent", F.floor(F.col("ay") / F.col("_size")).cast("long").alias("by"), F.floor(F.col("ax") / F.col("_size")).cast("long").alias("bx"))
        pairs = probe.join(right.hint("merge"), ["sample_id", "by", "bx"])
        pairs = pairs.withColumn("d2", (F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2)
        top = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*at).orderBy("d2", "dst"))).where(F.col("rank") <= most)
        full = F.max(F.when((F.col("rank") == most) & (F.sqrt("d2") <= F.col("_size")), True).otherwise(F.col("_size") >= F.col("_extent"))).over(Window.partitionBy(*at))
        top = top.withColumn("_full", full).where("_full").select(*at, "dst", F.sqrt("d2").alias("d"), "rank")
        top = written(top, "nearest")
        done.append(top)
        # Places without any candidate stay too, until buckets cover their sample.
        left = written(left.join(top.select(*at).distinct().hint("merge"), at, "left_anti").where(F.col("_extent") > own_size), "unsettled")
        rounds += 1
        if left.isEmpty():
            break
    lists = functools.reduce(DataFrame.unionByName, done).groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "d"))).alias("_near"))
    rows = a.select("sample_id", F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay")).join(lists.hint("merge"), at)
    near = F.filter("_near", lambda n: n["dst"] != F.col("src")) if own else F.col("_near")
    out = rows.select("sample_id", "src", F.posexplode(F.slice(near, 1, k)).alias("_at", "_n"))
    out = written(out.select("sample_id", "src", "_n.dst", "_n.d", (F.col("_at") + 1).alias("rank")), "nearest")
    return out.where(F.col("d") <= cap) if cap is not None else out


def _crowded(side: DataFrame, extent: DataFrame, most: int, halvings: int = 8) -> DataFrame:
    """``extent`` with first buckets halved until one that is in use holds ``most`` rows or fewer on average: rows may lie on a small part of their sample."""
    sizes = F.explode(F.array(*[F.struct(F.lit(h).alias("_h"), (F.col("_first") / float(2**h)).alias("_size")) for h in range(halvings + 1)]))
    used = side.join(extent, "sample_id").select("sample_id", "x", "y", sizes.alias("_s")).select("sample_id", "_s._h", F.xxhash64(_bucket("y", F.col("_s._size")), _bucket("x", F.col("_s._size"))).alias("_c"))
    held = used.groupBy("sample_id", "_h").agg((F.count("*") / F.approx_count_distinct("_c")).alias("_held"))
    fine = held.groupBy("sample_id").agg(F.coalesce(F.min(F.when(F.col("_held") <= most, F.col("_h"))), F.lit(halvings)).alias("_h"))
    out = extent.join(fine, "sample_id", "left").select("sample_id", "_extent", (F.col("_first") / F.pow(F.lit(2.0), F.coalesce("_h", F.lit(0)))).alias("_first"))
    return written(out, "extent")


def knn_edges(points: DataFrame, k: int, cap: float | None = None) -> DataFrame:
    """Each pair of which one is among the other's k nearest, once, src < dst."""
    found = nearest(points, points, k, own=True, cap=cap)
    return found.select("sample_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "d").dropDuplicates(["sample_id", "src", "dst"])


def grid_edges(patches: DataFrame, connectivity: int = 8) -> DataFrame:
    """Each pair of lattice neighbours (4 or 8), once, src < dst; never across a hole."""
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    here = patches.select("sample_id", F.col("patch_id").alias("a"), F.explode(F.array(*[F.struct((F.col("grid_y") + dy).alias("gy"), (F.col("grid_x") + dx).alias("gx")) for dy, dx in steps])).alias("s")).select("sample_id", "a", "s.gy", "s.gx")
    there = patches.select("sample_id", F.col("patch_id").alias("b"), F.col("grid_y").alias("gy"), F.col("grid_x").alias("gx"))
    pairs = here.join(there.hint("merge"), ["sample_id", "gy", "gx"])
    return pairs.select("sample_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of undirected edges."""
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def adopt_adjacency(directed: DataFrame, points: DataFrame) -> DataFrame:
    """Undirected edges with distances from directed ones of any direction; self loops go."""
    pairs = directed.where("src <> dst").select("sample_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    at = lambda end, p: points.select("sample_id", F.col("id").alias(end), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y")).hint("merge")
    both = pairs.join(at("src", "a"), ["sample_id", "src"]).join(at("dst", "b"), ["sample_id", "dst"])
    return both.select("sample_id", "src", "dst", F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2).alias("d"))


def transfer(source: DataFrame, target: DataFrame, radius: float, value: str = "value") -> DataFrame:
    """Each target row's mean, sum and largest of finite source values within ``radius``; n_sources counts all sources."""
    usable = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    near = range_join(target, source, radius).join(source.select("sample_id", F.col("id").alias("dst"), usable.alias("_v")), ["sample_id", "dst"])
    got = near.groupBy("sample_id", F.col("src").alias("id")).agg(F.count("*").alias("n_sources"), F.avg("_v").alias("mean"), F.sum("_v").alias("sum"), F.max("_v").alias("max"))
    out = target.select("sample_id", "id").join(got, ["sample_id", "id"], "left")
    return out.withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))


def transfer_nearest(source: DataFrame, target: DataFrame, cap: float | None = None, value: str = "value") -> DataFrame:
    """Each target row's nearest source value, null beyond ``cap``."""
    near = nearest(target, source, 1, cap=cap).join(source.select("sample_id", F.col("id").alias("dst"), F.col(value).alias("nearest")), ["sample_id", "dst"])
    out = target.select("sample_id", "id").join(near.select("sample_id", F.col("src").alias("id"), "nearest", "d"), ["sample_id", "id"], "left")
    return out.withColumn("n_sources", F.when(F.col("d").isNotNull(), 1).otherwise(0))


def edge_continuity(edges: DataFrame, foreground: DataFrame, n: int = 6) -> DataFrame:
    """Share of ``n`` evenly spaced places of each edge (sample_id, src, dst, ax, ay, bx, by) on ``foreground(sample_id, y, x)``; places round half to even."""
    steps = F.explode(F.array(*[F.lit(i / (n - 1)) for i in range(n)]))
    at = lambda a, b: F.bround(F.col(a) + (F.col(b) - F.col(a)) * F.col("t"), 0).cast("int")
    places = edges.withColumn("t", steps).select("sample_id", "src", "dst", at("ay", "by").alias("y"), at("ax", "bx").alias("x"))
    hit = places.join(foreground.select("sample_id", "y", "x", F.lit(1.0).alias("_on")), ["sample_id", "y", "x"], "left")
    return hit.groupBy("sample_id", "src", "dst").agg(F.avg(F.coalesce("_on", F.lit(0.0))).alias("continuity"))
