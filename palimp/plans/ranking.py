"""Order-dependent columns over groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: list[str], bucket: Column, order: list[Column], amount: Column, name: str, span: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the rows of ``group`` that come before this one.

    ``bucket`` cuts each group into ordered slices (rows of a smaller bucket come first); ``order``
    decides within a slice. Only the sums per slice are ordered group-wide, so a group that holds a
    third of all rows is still spread over its slices. Where the slices themselves are many, ``span``
    (buckets then being integers) sums them by runs of so many buckets first, and only the runs are
    ordered group-wide."""
    df = df.withColumns({"_rt_slice": bucket, "_rt_amount": amount})
    sums = df.groupBy(*group, "_rt_slice").agg(F.sum("_rt_amount").alias("_rt_sum"))
    if span:
        starts = running_total(sums.withColumnRenamed("_rt_slice", "_rt_no"), group, F.expr(f"floor(_rt_no / {int(span)})"), [F.col("_rt_no")], F.col("_rt_sum"), "_rt_begin").withColumnsRenamed({"_rt_no": "_rt_slice", "_rt_begin": "_rt_start"})
    else:
        before = Window.partitionBy(*group).orderBy("_rt_slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.withColumn("_rt_start", F.coalesce(F.sum("_rt_sum").over(before), F.lit(0)))
    starts = starts.select(*[F.col(g).alias(f"_rt_g{i}") for i, g in enumerate(group)], F.col("_rt_slice").alias("_rt_at"), "_rt_start")
    inside = Window.partitionBy(*group, "_rt_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_rt_local", F.coalesce(F.sum("_rt_amount").over(inside), F.lit(0)))
    on = [F.col(g).eqNullSafe(F.col(f"_rt_g{i}")) for i, g in enumerate(group)] + [F.col("_rt_slice").eqNullSafe(F.col("_rt_at"))]
    joined = local.join(starts, on, "left")
    return joined.withColumn(name, F.col("_rt_start") + F.col("_rt_local")).drop("_rt_slice", "_rt_amount", "_rt_local", "_rt_start", "_rt_at", *[f"_rt_g{i}" for i in range(len(group))])
