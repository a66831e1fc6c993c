"""Consecutive numbers in a global order, without bringing a group's rows into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.runtime import checkpointed


def numbered(rows: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... within each group (all rows, without groups) in ``order``, which tells a group's rows apart.

    Rows are dealt by ranges of groups and order, so a large group lies in many ranges. Numbers are counted inside ranges; the counts of the ranges
    before, one row for each range and group, are added. Null groups are groups, null keys come first.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(rows.repartitionByRange(n, *groups, *order).withColumn("_range", F.spark_partition_id()))  # read twice
    inside = placed.withColumn("_inside", F.row_number().over(W.partitionBy("_range", *groups).orderBy(*order)))
    counts = placed.groupBy("_range", *groups).agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").withColumnsRenamed({c: f"_of_{c}" for c in ["_range", *groups]})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ["_range", *groups]])
    return inside.join(before, same).select(*rows.columns, (F.col("_inside") + F.col("_before")).alias(name))
