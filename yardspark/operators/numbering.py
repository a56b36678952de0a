"""Row numbers over whole tables and large groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardspark.operators.assign import written


def number_rows(df: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """df with `name`: 1, 2, ... within the groups `by`, in order; equal rows in any order.

    Rows are sorted in ranges over many tasks and written with their places; a small table of each range's rows of each
    group gives the numbers before it.
    """
    keys = [*[F.col(c) for c in by], *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows.withColumn("_part", F.shiftright("_at", 33)))
    groups = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    held = rows.groupBy(*groups, F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*[f"_g{i}" for i in range(len(by))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(held, same).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))
