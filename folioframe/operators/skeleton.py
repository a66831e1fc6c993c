"""Missing and outlying ordinals of hierarchical numbering.

One shuffle by group: ordinals become a sorted set; runs, outliers and holes are array expressions on it. A group's
set holds distinct ordinals only, so repeated numbers do not grow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import strip

# fixed values: a clause number at the start of a line, and a table or figure caption
CLAUSE = r"^[#>\s*]*((?:[A-Z]|\d{1,2})(?:\.\d{1,2}){1,3})(?![\d.\-])"
CAPTION = r"^[#>\s*]*([表图])\s*((?:[A-Z]|\d{1,2})(?:\.\d{1,2}){1,3}(?:-\d{1,2})?)"


def split_number(num: Column) -> tuple[Column, Column]:
    """Parent and last ordinal; both null where the last part is no integer."""
    parts = F.split(num, r"\.")
    last = F.element_at(parts, -1).try_cast("int")
    return F.when(last.isNotNull(), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".")), last


def parse_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``kind`` ('clause', '表', '图'), ``num``, ``parent``, ``last`` to lines that hold a number; captions are tested first."""
    s = strip(F.col(text))
    caption, clause = F.regexp_extract(s, CAPTION, 2), F.regexp_extract(s, CLAUSE, 1)
    kind = F.when(caption != "", F.regexp_extract(s, CAPTION, 1)).when(clause != "", "clause")
    found = lines.withColumn("kind", kind).withColumn("num", F.when(caption != "", caption).otherwise(clause)).where(F.col("kind").isNotNull())
    parent, last = split_number(F.col("num"))
    return found.withColumn("parent", parent).withColumn("last", last)


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a line, numbered from 1."""
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(F.split(text, "\\R|[\x1c-\x1e]")).alias("line_no", text)).withColumn("line_no", F.col("line_no") + 1)


def ordinal_sets(rows: DataFrame, keys: list[str], ordinal: str = "last") -> DataFrame:
    """``keys, seq, lo, hi, run_end``: sorted distinct ordinals of each group and the end of the run that begins at the least."""
    sets = rows.where(F.col(ordinal).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_set(ordinal)).alias("seq"))
    lo = F.element_at("seq", 1)
    run = F.size(F.filter(F.transform("seq", lambda x, i: x - i), lambda d: d == lo))
    return sets.select(*keys, "seq", lo.alias("lo"), F.element_at("seq", -1).alias("hi"), (lo + run - 1).alias("run_end"))


def with_outliers(sets: DataFrame) -> DataFrame:
    """Adds ``outliers``: one or two ordinals more than 2 beyond the first run; otherwise empty."""
    far = F.filter("seq", lambda x: x > F.col("run_end") + 2)
    return sets.withColumn("outliers", F.when((F.size("seq") >= 2) & F.size(far).between(1, 2), far).otherwise(F.array().cast("array<int>")))


def with_missing(sets: DataFrame) -> DataFrame:
    """Adds ``missing`` between the least and the largest ordinal that is no outlier; ends are not judged."""
    kept = with_holes(sets)
    return kept.withColumn("missing", F.flatten(F.transform("holes", lambda h: F.sequence(h["lo"], h["hi"]))))


def with_holes(sets: DataFrame) -> DataFrame:
    """Adds ``kept`` (ordinals that are no outliers), ``hi`` (the largest) and ``holes``: array<struct<lo, hi>> of the runs that lack between neighbours."""
    kept = with_outliers(sets).withColumn("kept", F.array_except("seq", "outliers"))
    pairs = F.zip_with(F.col("kept"), F.slice("kept", F.lit(2), F.greatest(F.size("kept"), F.lit(1))), lambda a, b: F.struct((a + 1).alias("lo"), (b - 1).alias("hi")))
    return kept.withColumn("holes", F.filter(pairs, lambda h: h["lo"] <= h["hi"])).withColumn("hi", F.array_max("kept"))


def shown(holes: Column, long: int = 1_000) -> Column:
    """Missing ordinals joined by commas; a run of ``long`` or more as its ends."""
    ends = lambda h: F.concat(h["lo"].cast("string"), F.lit("-"), h["hi"].cast("string"))
    return F.array_join(F.transform(holes, lambda h: F.when(h["hi"] - h["lo"] >= long - 1, ends(h)).otherwise(F.array_join(F.sequence(h["lo"], h["hi"]), ","))), ",")


def issues(rows: DataFrame, keys: list[str], ordinal: str = "last") -> DataFrame:
    """``keys, type, ordinals, lo, hi``: 'suspect' (outliers) and 'missing' rows; ordinals joined by commas."""
    found = with_holes(ordinal_sets(rows, keys, ordinal))
    suspect = found.where(F.size("outliers") > 0).select(*keys, F.lit("suspect").alias("type"), F.array_join("outliers", ",").alias("ordinals"), "lo", "run_end")
    missing = found.where(F.size("holes") > 0).select(*keys, F.lit("missing").alias("type"), shown(F.col("holes")).alias("ordinals"), "lo", "hi")
    return suspect.union(missing).toDF(*keys, "type", "ordinals", "lo", "hi")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("cnt")).where("cnt > 1")


def verdicts(docs: DataFrame, parsed: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, n_clauses, n_issues, verdict``: 'not_applicable' without clauses, else 'gaps' or 'intact'."""
    n = parsed.where("kind = 'clause'").groupBy("doc_id").agg(F.count("*").alias("n_clauses"))
    m = found.groupBy("doc_id").agg(F.count("*").alias("n_issues"))
    out = docs.select("doc_id").distinct().join(n, "doc_id", "left").join(m, "doc_id", "left").na.fill(0, ["n_clauses", "n_issues"])
    return out.withColumn("verdict", F.when(F.col("n_clauses") == 0, "not_applicable").when(F.col("n_issues") > 0, "gaps").otherwise("intact"))
