"""The whole audit of transcriptions, on a fixture and on pages, and what follows from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import text as t
from folioframe.operators import audit as au
from folioframe.plans.audit import _SHAPES
from folioframe.plans.registry import Literal, query, table
from folioframe.plans.tokens import _NORMAL, _bag

_LONG = "正文" * 60
SOURCE = Literal("sp", "doc_id int, page int, text string", [
    (1, 1, "系数 1.90 H≤30 " + _LONG), (1, 2, "plain " + _LONG), (1, 3, "F = ma " + _LONG), (2, 1, "1 2 3 4 5 6 7 8 9 " + _LONG), (2, 2, "表 1.2 " + _LONG), (3, 1, ""), (3, 2, "x=y"),
    (4, 1, "A 10 " + _LONG), (4, 2, "B 20 " + _LONG), (5, 1, "甲" * 400), (6, 1, "10 " + _LONG), (6, 2, "∑ " + _LONG), (7, 1, "7 " + _LONG), *[(8, k, f"{k} " + _LONG) for k in range(1, 32)],
])
_TABLE = '<table><tr><td colspan="2">a</td></tr><tr><td>b</td><td>c</td></tr></table>'
MARKDOWN = Literal("md", "doc_id int, text string, other string", [
    (1, "系数 1 . 9 0 H<30 " + _LONG * 3, "系数 1.90 H<30"), (2, _LONG * 2 + " 1.2 " + _TABLE, None), (3, "7 " * 40, "1 " * 40), (4, "10 20 " + _LONG * 2 + _TABLE, "10 20" + _LONG), (5, "甲", None),
    (6, "10 ∑ " + _LONG * 2 + _TABLE + _TABLE + " ⅠⅠⅠ 1..2", "10 ∑"), (7, "7 " + _LONG + _TABLE, "7"), (8, " ".join(map(str, range(1, 32))) + _LONG * 31 + _TABLE, None),
])
BOXES = Literal("tb", "doc_id int, page int, tbl_no int, n_rows int, n_cols int", [(2, 2, 1, 2, 2), (2, 2, 2, 3, 3), (3, 1, 1, 2, 2), (4, 2, 1, 2, 3), (6, 1, 1, 2, 2), (6, 2, 1, 2, 2), (5, 1, 1, 4, 4)])


def _sql(source: str, md: str, boxes: str) -> str:
    """``source``: doc_id, page, text; ``md``: doc_id, text, other; ``boxes``: doc_id, page, tbl_no, n_rows, n_cols."""
    lists = "CASE WHEN len({0}) = 0 THEN 'none' WHEN len({0}) <= 25 THEN array_to_string({0}, ',') ELSE array_to_string({0}[1:25], ',') || ' +' || (len({0}) - 25) END"
    tier = "coalesce(list(page ORDER BY page) FILTER (tier = '{}'), [])"
    return f"""src AS ({source}), mds AS ({md}), box AS ({boxes}),
vol AS (SELECT doc_id, count(*) AS n_pages, sum(length(text))::BIGINT AS n_chars, coalesce(sum(length(text)), 0) < 20 * count(*) AS scanned FROM src GROUP BY 1),
nm AS (SELECT doc_id, {_NORMAL} AS x FROM (SELECT doc_id, text AS md FROM mds)), nm2 AS (SELECT doc_id, {_NORMAL} AS x FROM (SELECT doc_id, other AS md FROM mds WHERE other IS NOT NULL)),
p AS {_bag('doc_id, page', 'text', '(SELECT src.* FROM src JOIN vol USING (doc_id) WHERE NOT scanned)')}, m AS {_bag('doc_id', 'x', 'nm')}, m2 AS {_bag('doc_id', 'x', 'nm2')},
m1 AS (SELECT * FROM m WHERE doc_id IN (SELECT doc_id FROM nm2)),
dif AS (SELECT coalesce(m1.doc_id, m2.doc_id) AS doc_id, count(*) AS n FROM m1 FULL JOIN m2 ON (m1.doc_id, m1.kind, m1.tok) = (m2.doc_id, m2.kind, m2.tok) WHERE coalesce(m1.cnt, 0) <> coalesce(m2.cnt, 0) GROUP BY 1),
{_SHAPES.format(src='(SELECT doc_id, text AS html FROM mds)')},
st AS (SELECT box.*, row_number() OVER (PARTITION BY doc_id ORDER BY page, tbl_no) AS k FROM box JOIN vol USING (doc_id) WHERE NOT scanned),
cnt AS (SELECT vol.*, coalesce(a.n, 0) AS n_src, coalesce(b.n, 0) AS n_md FROM vol LEFT JOIN (SELECT doc_id, count(*) AS n FROM st GROUP BY 1) a USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM shp GROUP BY 1) b USING (doc_id)),
must AS (
  SELECT p.doc_id, p.page FROM p LEFT JOIN m ON (p.doc_id, p.kind, p.tok) = (m.doc_id, m.kind, m.tok) WHERE p.cnt > coalesce(m.cnt, 0)
  UNION SELECT src.doc_id, page FROM src JOIN cnt USING (doc_id) WHERE NOT scanned AND n_src = 0 AND n_md > 0 AND n_pages <= 30
  UNION SELECT st.doc_id, page FROM st JOIN cnt USING (doc_id) WHERE n_md > 0 AND n_src <> n_md
  UNION SELECT st.doc_id, page FROM st JOIN cnt USING (doc_id) JOIN shp ON shp.doc_id = st.doc_id AND shp.tbl_no = st.k WHERE n_src = n_md AND (st.n_rows, st.n_cols) <> (shp.n_rows, shp.n_cols)),
two AS (
  SELECT src.doc_id, page FROM src JOIN cnt USING (doc_id) WHERE NOT scanned AND n_src = 0 AND n_md > 0 AND n_pages > 30
  UNION SELECT st.doc_id, page FROM st JOIN cnt USING (doc_id) WHERE n_src = n_md OR n_md = 0),
tier AS (SELECT doc_id, page, min(tier) AS tier FROM (SELECT *, 'A' AS tier FROM must UNION ALL SELECT *, 'B' FROM two UNION ALL SELECT doc_id, page, 'C' FROM src WHERE regexp_matches(text, '[=＝].*[a-zA-Zαβγφσ]|[∑∫√]')) GROUP BY ALL),
lst AS (SELECT doc_id, count(*) AS n, {tier.format('A')} AS a, {tier.format('B')} AS b, {tier.format('C')} AS c FROM tier GROUP BY 1),
aud AS (SELECT mds.doc_id, n_pages, n_chars, length(text)::BIGINT AS md_chars, scanned, round(CASE WHEN n_chars > 0 THEN length(text) / n_chars ELSE 0 END, 6) AS ratio, n_src AS n_src_tables, n_md AS n_md_tables,
  CASE WHEN other IS NOT NULL THEN coalesce(dif.n, 0) END AS n_disagreements, coalesce({lists.format('a')}, 'none') AS must, coalesce({lists.format('b')}, 'none') AS tables, coalesce({lists.format('c')}, 'none') AS formulas,
  coalesce(lst.n, 0) > n_pages * 0.5 AS too_many,
  list_filter([CASE WHEN length(text) < 50 THEN 'nearly_empty' END, CASE WHEN NOT scanned AND n_chars > 0 AND length(text) / n_chars < 0.7 THEN 'content_lost' END, CASE WHEN regexp_matches(text, '\\p{{Nd}}\\.\\.\\p{{Nd}}') THEN 'glitch_double_point' END,
    CASE WHEN contains(text, chr(65533)) THEN 'glitch_replacement' END, CASE WHEN regexp_matches(text, '[IⅠ]{{3,}}') THEN 'glitch_roman_pile' END, CASE WHEN n_src <> n_md AND NOT scanned AND NOT (n_src = 0 AND n_md > 0) THEN 'table_count' END], lambda x: x IS NOT NULL) AS r
  FROM mds JOIN cnt USING (doc_id) LEFT JOIN lst USING (doc_id) LEFT JOIN dif USING (doc_id))"""


_AUDIT = "SELECT * EXCLUDE (r), array_to_string(r, ',') AS red, CASE WHEN len(r) > 0 THEN 1 ELSE 0 END AS exit_code FROM aud"
_FIXTURE = f"WITH {SOURCE.sql}, {MARKDOWN.sql}, {BOXES.sql}, {_sql('SELECT * FROM sp', 'SELECT * FROM md', 'SELECT * FROM tb')}"
_NO_BOXES = "SELECT 1::BIGINT AS doc_id, 1 AS page, 1 AS tbl_no, 1 AS n_rows, 1 AS n_cols WHERE false"
# the HTML of a page stands for its original, the text without tags for the transcription, and that with some digits changed for a second one
_PAGES = f"WITH {_sql('SELECT page_id AS doc_id, 1 AS page, html AS text FROM pages', '''SELECT page_id AS doc_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text, regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '7', '1', 'g') AS other FROM pages''', _NO_BOXES)}"


def _fixture(spark):
    md = MARKDOWN.df(spark)
    return SOURCE.df(spark), md.select("doc_id", "text"), BOXES.df(spark), md.where("other IS NOT NULL").select("doc_id", F.col("other").alias("text"))


def _pages(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.col("html").alias("text"))
    md = p.select("doc_id", t.without_tags(F.col("text")).alias("text"))
    boxes = spark.createDataFrame([], "doc_id long, page int, tbl_no int, n_rows int, n_cols int")
    return p, md, boxes, md.select("doc_id", F.regexp_replace("text", "7", "1").alias("text"))


@query("transcription_audit_fixture", f"{_FIXTURE} {_AUDIT}")
def transcription_audit_fixture(spark, d):
    return au.transcription(*_fixture(spark))


@query("transcription_audit", f"{_PAGES} {_AUDIT}")
def transcription_audit(spark, d):
    return au.transcription(*_pages(spark, d))


@query("page_provenance", f"{_FIXTURE} SELECT doc_id, page, tier, CASE WHEN doc_id = 1 OR page = 2 THEN '{au.VERIFIED}' ELSE '{au.UNVERIFIED}' END AS provenance FROM tier")
def page_provenance(spark, d):
    pages, md, boxes, _ = _fixture(spark)
    return au.provenance(au.transcription_pages(pages, md, boxes), pages.where("doc_id = 1 OR page = 2").select("doc_id", "page"))


@query("page_tiers", f"{_PAGES} SELECT * FROM tier")
def page_tiers(spark, d):
    return au.transcription_pages(*_pages(spark, d)[:3])


@query("coverage_warning", f"{_FIXTURE} SELECT doc_id, coalesce(n, 0) AS n_listed, n_pages, coalesce(n, 0) > n_pages * 0.5 AS too_many FROM vol LEFT JOIN lst USING (doc_id)")
def coverage_warning(spark, d):
    pages, md, boxes, _ = _fixture(spark)
    return au.coverage(au.transcription_pages(pages, md, boxes), au.volume(pages, ["doc_id"]))


@query("page_lists", f"""{_FIXTURE}, l AS (SELECT doc_id, tier, list(page ORDER BY page) AS p FROM tier GROUP BY ALL)
SELECT doc_id, tier, CASE WHEN len(p) <= 25 THEN array_to_string(p, ',') ELSE array_to_string(p[1:25], ',') || ' +' || (len(p) - 25) END AS pages FROM l""")
def page_lists(spark, d):
    pages, md, boxes, _ = _fixture(spark)
    return au.transcription_pages(pages, md, boxes).groupBy("doc_id", "tier").agg(au.capped_list(F.sort_array(F.collect_list("page"))).alias("pages"))


@query("doc_verdict", f"{_PAGES} SELECT doc_id, CASE WHEN len(r) > 0 THEN 1 ELSE 0 END AS exit_code, CASE WHEN len(r) > 0 THEN 'red' ELSE 'passed' END AS verdict FROM aud")
def doc_verdict(spark, d):
    return au.transcription(*_pages(spark, d)).select("doc_id", "exit_code", F.when(F.col("exit_code") == 1, "red").otherwise("passed").alias("verdict"))
