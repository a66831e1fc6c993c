"""Declarative checks of parameter tables: ranges, cross-field and cross-row rules. Values are never altered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: metric, normal band, suspicious below and above, certain error at or below (strictly: see CERTAIN_STRICT)
SOIL_RANGES = [
    ("gamma", 16.0, 22.0, 14.0, 23.0, None), ("c", 0.0, 100.0, None, 200.0, 0.0), ("phi", 0.0, 45.0, None, 45.0, 0.0), ("es", 2.0, 50.0, 1.0, 100.0, None), ("fak", 50.0, 500.0, 30.0, 1000.0, None),
    ("thickness", 0.0, 1e9, None, None, 0.0), ("e", 0.4, 1.5, 0.3, 2.5, None), ("w", 10.0, 60.0, 5.0, 100.0, None), ("n", 0.0, 50.0, None, 60.0, None),
]
#: Metrics for which the bound itself is fine and only values below it are certain errors.
CERTAIN_STRICT = ("c", "phi")
RANGE_SCHEMA = "metric string, lo double, hi double, sus_lo double, sus_hi double, err_at double"
# fixed values: words in layer names
SAND, CLAY, MUD, ROCK = "砂", "黏土|粘土", "淤泥", "岩|湿陷|膨胀|冻土"


def long_form(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``keys, metric, value`` without missing values, which get no verdict."""
    return rows.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value").where("value IS NOT NULL")


def check_ranges(values: DataFrame, ranges: DataFrame, strict: tuple[str, ...] = CERTAIN_STRICT) -> DataFrame:
    """Adds ``severity``: 'certain', 'suspicious', 'review' (outside the normal band only) or 'ok'. ``ranges`` is a constant table."""
    j = values.join(F.broadcast(ranges), "metric")
    certain = F.when(F.col("metric").isin(*strict), F.col("value") < F.col("err_at")).otherwise(F.col("value") <= F.col("err_at"))
    suspicious = F.coalesce(F.col("value") < F.col("sus_lo"), F.lit(False)) | F.coalesce(F.col("value") > F.col("sus_hi"), F.lit(False))
    severity = F.when(F.coalesce(certain, F.lit(False)), "certain").when(suspicious, "suspicious").when(~F.col("value").between(F.col("lo"), F.col("hi")), "review").otherwise("ok")
    return j.withColumn("severity", severity).drop("sus_lo", "sus_hi", "err_at")


def exempted(checked: DataFrame, name: Column) -> DataFrame:
    """Special soils and rock get a notice instead of a verdict."""
    return checked.withColumn("severity", F.when((F.col("severity") != "ok") & F.rlike(name, F.lit(ROCK)), "notice").otherwise(F.col("severity")))


def decimal_hint(checked: DataFrame) -> DataFrame:
    """Adds ``hint``: the first of value/10, /100 and x10 that lies in the normal band, where the value is suspicious."""
    tries = F.array(F.col("value") / 10, F.col("value") / 100, F.col("value") * 10)
    fit = F.filter(tries, lambda x: x.between(F.col("lo"), F.col("hi")))
    return checked.withColumn("hint", F.when(F.col("severity") == "suspicious", F.get(fit, F.lit(0))))


def column_shift(checked: DataFrame, share: float = 0.5) -> DataFrame:
    """``metric, n, n_out, shifted``: a column most of whose values are out of band is taken for a swapped column."""
    out = checked.groupBy("metric").agg(F.count("*").alias("n"), F.count_if(F.col("severity") != "ok").alias("n_out"))
    return out.withColumn("shifted", F.col("n_out") > F.col("n") * share)


def summary(checked: DataFrame, key: str) -> DataFrame:
    """One row, also when nothing is found: layers, findings by certainty."""
    return checked.agg(F.countDistinct(key).alias("n_layers"), F.count_if(F.col("severity") == "certain").alias("n_certain"), F.count_if(F.col("severity") == "suspicious").alias("n_suspicious"), F.count_if(F.col("severity") == "review").alias("n_review"))


def cross_rules(layers: DataFrame, key: str = "layer_no", soft_es: float = 10.0, hard_es: float = 4.0) -> DataFrame:
    """``key, rule`` of layers whose fields contradict each other."""
    name = F.col("name")
    sand, clay, mud = F.rlike(name, F.lit(SAND)), F.rlike(name, F.lit(CLAY)), F.rlike(name, F.lit(MUD))
    rules = [
        ("sand_with_cohesion", sand & (F.col("c") > 10)), ("clay_with_large_phi", clay & (F.col("phi") > 30)), ("mud_with_large_gamma", mud & (F.col("gamma") > 18)),
        ("gamma_against_e", (F.col("gamma") > 20) & (F.col("e") > 1.0)), ("soft_with_large_es", mud & (F.col("es") > soft_es)), ("hard_with_small_es", F.rlike(name, F.lit("硬|密实")) & (F.col("es") < hard_es)),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return layers.select(key, F.explode(found).alias("rule"))


def conflicting(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same key with different values in several tables."""
    return rows.groupBy(*keys).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def monotonic(rows: DataFrame, group: str, order: str, bottom: str, thickness: str | None = None, tolerance: float = 0.01) -> DataFrame:
    """Adds ``falls`` (below the one before) and, with a thickness, ``fits`` (the fall equals it)."""
    w = W.partitionBy(group).orderBy(order)
    out = rows.withColumn("before", F.lag(bottom).over(w)).withColumn("falls", F.col("before").isNull() | (F.col(bottom) < F.col("before")))
    if thickness:
        out = out.withColumn("fits", F.col("before").isNull() | (F.abs(F.col("before") - F.col(bottom) - F.col(thickness)) <= tolerance))
    return out.drop("before")
