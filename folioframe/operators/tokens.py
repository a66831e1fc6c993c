"""Token multisets of texts, and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.functions.text import COMPARATORS, NUMBER, ROMANS, UNITS, fold_width


def _kind(token: Column) -> Column:
    return F.when(F.lit(COMPARATORS).contains(token), "cmp").when(F.lit(ROMANS).contains(token), "rom").when(F.lit(UNITS).contains(token), "unit").otherwise("num")


def multiset(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys, kind, tok, cnt``: numbers, and single comparators, roman numerals and unit signs, of the width-folded text."""
    # texts without digits and symbols have no tokens; full-width digits are digits too
    held = rows.select(*keys, text.alias("_text")).where(F.rlike("_text", F.lit(rf"[\p{{Nd}}{COMPARATORS}{ROMANS}{UNITS}]"))).select(*keys, fold_width(F.col("_text")).alias("_text"))
    found = held.select(*keys, F.explode(F.regexp_extract_all("_text", F.lit(f"{NUMBER}|[{COMPARATORS}{ROMANS}{UNITS}]"), F.lit(0))).alias("tok"))
    return found.groupBy(*keys, "tok").agg(F.count("*").alias("cnt")).select(*keys, _kind(F.col("tok")).alias("kind"), "tok", "cnt")


def deficit(page_tokens: DataFrame, doc_tokens: DataFrame) -> DataFrame:
    """``doc_id, page, kind, tok, short``: tokens that a page has more often than the whole document that it is compared to."""
    d = doc_tokens.select("doc_id", "kind", "tok", F.col("cnt").alias("there"))
    out = page_tokens.join(d, ["doc_id", "kind", "tok"], "left").withColumn("short", F.col("cnt") - F.coalesce("there", F.lit(0)))
    return out.where("short > 0").select("doc_id", "page", "kind", "tok", "short")


def fold(deficits: DataFrame, dense: int = 8) -> DataFrame:
    """``doc_id, page, n_missing, finding``: pages with many missing kinds are to be read whole."""
    return deficits.groupBy("doc_id", "page").agg(F.count("*").alias("n_missing")).withColumn("finding", F.when(F.col("n_missing") >= dense, "read_whole_page").otherwise("listed"))


def listed(deficits: DataFrame, dense: int = 8, shown: int = 12) -> DataFrame:
    """``doc_id, page, missing``: tokens that a page lacks and how many of each, the first ``shown`` in order of kind and token; pages that lack ``dense`` or more are left to ``fold``."""
    rows = deficits.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("kind", "tok", "short"))).alias("m")).where(F.size("m") < dense)
    text = lambda x: F.concat(x["tok"], F.lit(" -"), x["short"].cast("string"))
    return rows.select("doc_id", "page", F.array_join(F.transform(F.slice("m", 1, shown), text), ", ").alias("missing"))


def difference(a: DataFrame, b: DataFrame, keys: list[str], top: int | None = None) -> DataFrame:
    """``keys, kind, tok, a, b`` where two multisets disagree; the first ``top`` of each group in order of kind and token."""
    on = [*keys, "kind", "tok"]
    out = a.withColumnRenamed("cnt", "a").join(b.withColumnRenamed("cnt", "b"), on, "full").na.fill(0, ["a", "b"]).where("a <> b")
    if top is not None:
        out = out.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("kind", "tok"))).where(F.col("rn") <= top).drop("rn")
    return out.select(*on, "a", "b")
