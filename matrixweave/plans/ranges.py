"""Running values over a whole ordered table, without gathering it in one task.

The table is dealt by ranges of its key and written with the number of each row's range.
Within a range a window runs; what the ranges before or after it hold is one row a
range, so that the tables broadcast are as long as there are shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrixweave.plans.scratch import written


def ranges_before() -> Window:
    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def ranges_after() -> Window:
    return Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)


def in_ranges(df: DataFrame, key: str, tag: str) -> DataFrame:
    """``df`` with _part, written: a row of a smaller key is of no larger _part, and equal keys are of one."""
    return written(df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), tag)


def up_to(key: str) -> Window:
    """The rows of a range up to the present one."""
    return Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)


def from_on(key: str) -> Window:
    """The rows of a range from the present one on."""
    return Window.partitionBy("_part").orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)


def with_running_sums(ranges: DataFrame, key: str, **sums: Column) -> DataFrame:
    """``ranges`` with the sum of each of ``sums`` up to each row of the whole table, and as name_all that of all rows."""
    parts = ranges.groupBy("_part").agg(*[F.sum(c).alias(f"{n}_part") for n, c in sums.items()])
    whole = Window.partitionBy()
    parts = parts.select("_part", *[F.coalesce(F.sum(f"{n}_part").over(ranges_before()), F.lit(0)).alias(f"{n}_before") for n in sums], *[F.sum(f"{n}_part").over(whole).alias(f"{n}_all") for n in sums])
    out = ranges.join(F.broadcast(parts), "_part")
    out = out.withColumns({n: F.sum(c).over(up_to(key)) + F.col(f"{n}_before") for n, c in sums.items()})
    return out.drop(*[f"{n}_before" for n in sums])
