"""Queries on numbering: line items as numbered groups, and clause lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import skeleton as sk
from folioframe.plans.registry import Literal, query, table
from folioframe.sources.sinks import report_text

LINES = Literal("fx", "doc_id int, line_no int, text string", [
    (1, 1, "4.1.1 a"), (1, 2, "4.1.2 b"), (1, 3, "4.1.4 d"),
    (2, 1, "11.9.1 a"), (2, 2, "11.9.2 b"), (2, 3, "11.9.3 c"), (2, 4, "11.9.28度"),
    (3, 1, "图 6.2.10"), (3, 2, "图 6.2.11"), (3, 3, "图 6.2.15"),
    (4, 1, "图 6.2.10"), (4, 2, "图 6.2.11"), (4, 3, "图 6.2.15"), (4, 4, "图 6.2.16"), (4, 5, "图 6.2.17"),
    (5, 1, "表 4.1.3-1"), (5, 2, "表 4.1.3-3"),
    (6, 1, "## 6.2.1正截面"), (6, 2, "6.2.1-1"), (6, 3, "6.2.123"),
    (7, 1, "1.5倍"), (8, 1, "plain prose"), (9, 1, "A.0.1 x"), (9, 2, "A.0.3 z"), (10, 1, "3.1.1 a"), (10, 2, "  > 3.1.2 b"),
])

_SETS = """s AS (SELECT DISTINCT l_orderkey AS parent, l_linenumber AS v FROM lineitem),
i AS (SELECT parent, v, v - row_number() OVER (PARTITION BY parent ORDER BY v) AS island FROM s),
g AS (SELECT parent, count(*) AS n, min(v) AS lo, max(v) AS hi, list(v ORDER BY v) AS seq FROM s GROUP BY parent),
r AS (SELECT g.*, (SELECT max(v) FROM i WHERE i.parent = g.parent AND i.island = g.lo - 1) AS run_end FROM g),
o AS (SELECT *, list_filter(seq, lambda x: x > run_end + 2) AS far FROM r),
q AS (SELECT *, CASE WHEN n >= 2 AND len(far) BETWEEN 1 AND 2 THEN far ELSE [] END AS outliers FROM o),
k AS (SELECT *, list_filter(seq, lambda x: NOT list_contains(outliers, x)) AS kept FROM q),
m AS (SELECT *, list_filter(range(list_min(kept), list_max(kept) + 1), lambda x: NOT list_contains(kept, x)) AS missing FROM k)"""


def _sets(spark, d):
    return sk.ordinal_sets(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("last")), ["parent"])


@query("skeleton_gaps", f"WITH {_SETS} SELECT parent, array_to_string(missing, ',') AS missing, lo, list_max(kept) AS hi FROM m WHERE n >= 2 AND len(missing) > 0")
def skeleton_gaps(spark, d):
    return sk.with_holes(_sets(spark, d)).where(F.size("holes") > 0).select("parent", sk.shown(F.col("holes")).alias("missing"), "lo", "hi")


@query("skeleton_runs", f"WITH {_SETS} SELECT parent, n, lo, hi, run_end FROM r")
def skeleton_runs(spark, d):
    return _sets(spark, d).select("parent", F.size("seq").cast("long").alias("n"), "lo", "hi", "run_end")


@query("skeleton_outliers", f"WITH {_SETS} SELECT parent, run_end, array_to_string(outliers, ',') AS outliers FROM q WHERE len(outliers) > 0")
def skeleton_outliers(spark, d):
    return sk.with_outliers(_sets(spark, d)).where(F.size("outliers") > 0).select("parent", "run_end", F.array_join("outliers", ",").alias("outliers"))


@query("ordinal_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS cnt FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def ordinal_duplicates(spark, d):
    return sk.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("ordinal_conflicts", "SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS n_values FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1")
def ordinal_conflicts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.countDistinct("l_partkey").alias("n_values")).where("n_values > 1")


_PARSE = LINES.sql + r""",
t AS (SELECT doc_id, line_no, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM fx),
c AS (SELECT *, regexp_extract(s, '^[#>\s*]*([表图])\s*((?:[A-Z]|\d{1,2})(?:\.\d{1,2}){1,3}(?:-\d{1,2})?)', 2) AS cap,
             regexp_extract(s, '^[#>\s*]*([表图])', 1) AS capk, regexp_extract(s, '^[#>\s*]*((?:[A-Z]|\d{1,2})(?:\.\d{1,2}){1,3})(?:[^\d.\-]|$)', 1) AS cl FROM t),
p AS (SELECT doc_id, line_no, CASE WHEN cap <> '' THEN capk ELSE 'clause' END AS kind, CASE WHEN cap <> '' THEN cap ELSE cl END AS num FROM c WHERE cap <> '' OR cl <> ''),
n AS (SELECT *, TRY_CAST(string_split(num, '.')[-1] AS INTEGER) AS last, CASE WHEN TRY_CAST(string_split(num, '.')[-1] AS INTEGER) IS NOT NULL THEN array_to_string(string_split(num, '.')[:-2], '.') END AS parent FROM p)"""


@query("clause_parse", f"WITH {_PARSE} SELECT doc_id, line_no, kind, num, parent, last FROM n")
def clause_parse(spark, d):
    return sk.parse_lines(LINES.df(spark)).select("doc_id", "line_no", "kind", "num", "parent", "last")


@query("caption_parse", f"WITH {_PARSE} SELECT doc_id, line_no, kind, num FROM n WHERE kind <> 'clause'")
def caption_parse(spark, d):
    return sk.parse_lines(LINES.df(spark)).where("kind <> 'clause'").select("doc_id", "line_no", "kind", "num")


@query("clause_census", f"WITH {_PARSE} SELECT doc_id, count(*) FILTER (kind = 'clause') AS clauses, count(*) FILTER (kind = '表') AS tables, count(*) FILTER (kind = '图') AS figures FROM n GROUP BY doc_id")
def clause_census(spark, d):
    return sk.parse_lines(LINES.df(spark)).groupBy("doc_id").agg(F.count_if(F.col("kind") == "clause").alias("clauses"), F.count_if(F.col("kind") == "表").alias("tables"), F.count_if(F.col("kind") == "图").alias("figures"))


_FX_SETS = _PARSE + """,
s AS (SELECT DISTINCT doc_id, kind, parent, last AS v FROM n WHERE last IS NOT NULL),
g AS (SELECT doc_id, kind, parent, count(*) AS n, min(v) AS lo, list(v ORDER BY v) AS seq FROM s GROUP BY ALL),
i AS (SELECT *, v - row_number() OVER (PARTITION BY doc_id, kind, parent ORDER BY v) AS island FROM s),
r AS (SELECT g.*, (SELECT max(v) FROM i WHERE (i.doc_id, i.kind, i.parent) = (g.doc_id, g.kind, g.parent) AND i.island = g.lo - 1) AS run_end FROM g WHERE n >= 2),
o AS (SELECT *, list_filter(seq, lambda x: x > run_end + 2) AS far FROM r),
q AS (SELECT *, CASE WHEN len(far) BETWEEN 1 AND 2 THEN far ELSE [] END AS outliers FROM o),
k AS (SELECT *, list_filter(seq, lambda x: NOT list_contains(outliers, x)) AS kept FROM q),
m AS (SELECT *, list_filter(range(list_min(kept), list_max(kept) + 1), lambda x: NOT list_contains(kept, x)) AS missing FROM k),
u AS (SELECT doc_id, kind, parent, 'suspect' AS type, array_to_string(outliers, ',') AS ordinals, lo, run_end AS hi FROM m WHERE len(outliers) > 0
      UNION ALL SELECT doc_id, kind, parent, 'missing', array_to_string(missing, ','), lo, list_max(kept) FROM m WHERE len(missing) > 0)"""


@query("skeleton_fixture", f"WITH {_FX_SETS} SELECT * FROM u")
def skeleton_fixture(spark, d):
    return sk.issues(sk.parse_lines(LINES.df(spark)), ["doc_id", "kind", "parent"])


@query("skeleton_verdict", f"""WITH {_FX_SETS} SELECT d.doc_id, (SELECT count(*) FROM n WHERE n.doc_id = d.doc_id AND kind = 'clause') AS n_clauses, (SELECT count(*) FROM u WHERE u.doc_id = d.doc_id) AS n_issues,
CASE WHEN (SELECT count(*) FROM n WHERE n.doc_id = d.doc_id AND kind = 'clause') = 0 THEN 'not_applicable' WHEN (SELECT count(*) FROM u WHERE u.doc_id = d.doc_id) > 0 THEN 'gaps' ELSE 'intact' END AS verdict
FROM (SELECT DISTINCT doc_id FROM fx) d""")
def skeleton_verdict(spark, d):
    parsed = sk.parse_lines(LINES.df(spark))
    return sk.verdicts(LINES.df(spark), parsed, sk.issues(parsed, ["doc_id", "kind", "parent"]))


@query("issue_report", """SELECT doc_id, report FROM (VALUES (1, '4.1 missing 3'), (2, '11.9 suspect 28'), (3, '6.2 suspect 15'), (4, '6.2 missing 12,13,14'), (9, 'A.0 missing 2'), (20, '10.1 missing 2' || chr(10) || '2.1 missing 2' || chr(10) || '2.1.1 suspect 4')) t(doc_id, report)""")
def issue_report(spark, d):
    """Reports in order of parents as lists of strings: 10 before 2, 2.1 before 2.1.1."""
    more = spark.createDataFrame([(20, k, x) for k, x in enumerate(["2.1.1 a", "2.1.3 b", "10.1.1 a", "10.1.3 b", "2.1.1.1 x", "2.1.1.4 y"])], "doc_id int, line_no int, text string")
    found = sk.issues(sk.parse_lines(LINES.df(spark).union(more)), ["doc_id", "kind", "parent"])
    lines = found.select("doc_id", F.split("parent", r"\.").alias("section"), F.lit(1).alias("ord"), F.concat_ws(" ", "parent", "type", "ordinals").alias("line"))
    return report_text(lines)
