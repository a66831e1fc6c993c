"""Aggregates of a key beside its rows, and connected components, both safe for keys that hold many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm._spark import checkpointed

#: Parts that a key's rows are dealt into.
SALTS = 64


def salt(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def summed(rows: DataFrame, key: str, partial: list[Column], final: list[Column]) -> DataFrame:
    """One row a key: ``final`` over ``partial``, and ``_salts``: which parts (column ``_salt``) it has rows in."""
    return rows.groupBy(key, "_salt").agg(*partial).groupBy(key).agg(*final, F.collect_set("_salt").alias("_salts"))


def beside(rows: DataFrame, key: str, per_key: DataFrame) -> DataFrame:
    """Rows (with ``_salt``) joined with the row of their key; a key's row goes only to the parts that it has."""
    dealt = per_key.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return rows.join(dealt, [key, "_salt"])


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (u long, v long); root is the component's least node.

    Alternating large-star and small-star contractions; every round is written to the checkpoint folder.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpointed(e)
    seen = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v").withColumn("_salt", salt("v"))
        least = summed(both, "u", [F.min("v").alias("m")], [F.least(F.min("m"), F.col("u")).alias("m")])
        large = beside(both, "u", least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().withColumn("_salt", salt("v"))
        least = summed(large, "u", [F.min("v").alias("m")], [F.min("m").alias("m")])
        near = beside(large, "u", least)
        small = near.select("u", F.col("m").alias("v")).union(near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = checkpointed(small)
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.crc32(F.concat_ws(",", "u", "v")))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
        seen = now
    raise RuntimeError("components did not settle")
