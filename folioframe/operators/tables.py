"""Shapes of tables in HTML, and their comparison with those of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shapes(html: Column) -> Column:
    """array<struct<n_rows, n_cols>> of the tables (lower-case tags) that have rows; a cell counts as often as its colspan says."""
    def width(row: Column) -> Column:
        cells = F.regexp_extract_all(row, F.lit(r"<t[dh]\b([^>]*)>"), F.lit(1))
        span = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r'colspan\s*=\s*"?(\d+)', 1), F.lit("")).try_cast("int"), F.lit(1))
        return F.aggregate(F.transform(cells, span), F.lit(0), lambda a, x: a + x)

    def shape(table: Column) -> Column:
        rows = F.regexp_extract_all(table, F.lit(r"(?s)<tr.*?</tr>"), F.lit(0))
        return F.struct(F.size(rows).alias("n_rows"), F.coalesce(F.array_max(F.transform(rows, width)), F.lit(0)).alias("n_cols"))

    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<table.*?</table>"), F.lit(0)), shape), lambda s: s["n_rows"] > 0)


def pair(source: DataFrame, md: DataFrame) -> DataFrame:
    """``doc_id, tbl_no, page, src, md, same`` by position, for documents whose two sides have equally many tables.

    ``source``: doc_id, page, tbl_no, n_rows, n_cols; ``md``: doc_id, tbl_no, n_rows, n_cols.
    """
    a = source.withColumn("n", F.count("*").over(W.partitionBy("doc_id"))).withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy("page", "tbl_no")))
    b = md.withColumn("n", F.count("*").over(W.partitionBy("doc_id"))).withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy("tbl_no")))
    text = lambda x: F.concat(F.col(f"{x}.n_rows").cast("string"), F.lit("x"), F.col(f"{x}.n_cols").cast("string"))
    j = a.alias("a").join(b.alias("b"), ["doc_id", "n", "k"])
    return j.select("doc_id", F.col("k").alias("tbl_no"), "a.page", text("a").alias("src"), text("b").alias("md"), (text("a") == text("b")).alias("same"))


def findings(docs: DataFrame, few_pages: int = 30) -> DataFrame:
    """What the numbers of tables say. ``docs``: doc_id, n_pages, n_src, n_md, scanned.

    Adds ``red`` and ``pages_to``: where all pages go ('A', 'B'), 'paired' if tables are compared one by one, or 'source_pages'.
    """
    unseen = (F.col("n_src") == 0) & (F.col("n_md") > 0) & ~F.col("scanned")
    differ = (F.col("n_src") != F.col("n_md")) & ~F.col("scanned") & ~unseen
    to = F.when(unseen, F.when(F.col("n_pages") <= few_pages, "A").otherwise("B")).when((F.col("n_src") > 0) & (F.col("n_md") > 0), F.when(F.col("n_src") == F.col("n_md"), "paired").otherwise("source_pages")).otherwise("none")
    return docs.withColumn("red", differ).withColumn("pages_to", to)
