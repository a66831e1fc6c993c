"""Queries on volume, lines, faults, tables, tiers and media."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import text as t
from folioframe.operators import audit as au
from folioframe.operators import media as me
from folioframe.operators import skeleton as sk
from folioframe.operators import tables as tb
from folioframe.operators.order import numbered
from folioframe.plans.registry import Literal, query, table

HEADS = Literal("fx", "doc_id int, line_no int, text string", [
    (1, 1, "- 12 -"), (1, 2, "GB 50010"), (1, 3, "Body one"), (1, 4, "7"), (1, 5, "Body two"), (1, 6, "13"),
    (2, 1, "GB50010正文"), (2, 2, "Text"), (3, 1, "1"), (3, 2, "2"), (4, 1, "1.1 总则......109"), (4, 2, "1.2 术语…… 5"), (4, 3, "plain 3 ...."),
    (5, 1, "a ....1"), (5, 2, "b ....."), (5, 3, "c ......"), (5, 4, "d ···· x"), (5, 5, "e …… "), (5, 6, "f .... z"), (5, 7, "g ... y"),
])
_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_HEAD = rf"({_TRIM} <> '' AND length({_TRIM}) <= 24 AND regexp_full_match({_TRIM}, '[-—\s]*\p{{Nd}}{{1,4}}[-—\s]*|[A-Z]{{1,4}}[\s/]?\p{{Nd}}{{3,5}}[\s—-]*\p{{Nd}}{{0,4}}'))"
_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("line_no"), "text")


@query("text_volume", "SELECT source, count(*) AS n_pages, sum(length(text))::BIGINT AS n_chars, coalesce(sum(length(text)), 0) < 20 * count(*) AS scanned FROM documents GROUP BY source")
def text_volume(spark, d):
    return au.volume(table(spark, d, "documents"), ["source"])


@query("scan_flag", "SELECT lang, source, sum(length(text)) < 2000 * count(*) AS scanned, count(*) AS n_pages, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY ALL")
def scan_flag(spark, d):
    return au.volume(table(spark, d, "documents"), ["lang", "source"], least=2000)


@query("volume_ratio", """SELECT page_id, ratio, CASE WHEN ratio < 0.7 THEN 'content_lost' WHEN ratio BETWEEN 0.8 AND 1.4 THEN 'normal' ELSE 'unusual' END AS finding
FROM (SELECT page_id, CASE WHEN length(html) > 0 THEN length(regexp_replace(html, '<[^>]*>', '', 'g')) / length(html) ELSE 0.0 END AS ratio FROM pages)""")
def volume_ratio(spark, d):
    ratio, finding = au.volume_verdict(F.length(t.without_tags(F.col("html"))), F.length("html"))
    return table(spark, d, "pages").select("page_id", ratio.alias("ratio"), finding.alias("finding"))


@query("glitch_scan", """SELECT doc_id, glitch, len(m)::BIGINT AS hits, array_to_string(m[1:5], ' ') AS samples FROM (
SELECT doc_id, 'double_point' AS glitch, regexp_extract_all(text, '\\p{Nd}\\.\\.\\p{Nd}') AS m FROM x UNION ALL
SELECT doc_id, 'roman_pile', regexp_extract_all(text, '[IⅠ]{3,}') FROM x UNION ALL
SELECT doc_id, 'replacement', regexp_extract_all(text, chr(65533)) FROM x) WHERE len(m) > 0""".replace("\\\\", "\\").replace("FROM x", "FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES (-1, '2..5 and 3..4'), (-2, 'Type III'), (-3, chr(65533)), (-4, 'II 2.5')))"))
def glitch_scan(spark, d):
    extra = spark.createDataFrame([(-1, "2..5 and 3..4"), (-2, "Type III"), (-3, "�"), (-4, "II 2.5")], "doc_id long, text string")
    return au.glitches(table(spark, d, "documents").select("doc_id", "text").union(extra), ["doc_id"])


@query("mojibake_scan", r"SELECT doc_id, len(regexp_extract_all(text, '\x00')) AS nul, len(regexp_extract_all(text, '[\x{E000}-\x{F8FF}]')) AS private_use, len(regexp_extract_all(text, '\x{FFFD}')) AS replacement FROM documents")
def mojibake_scan(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, d, "documents").select("doc_id", n(r"\x00").alias("nul"), n(r"[\x{E000}-\x{F8FF}]").alias("private_use"), n(r"\x{FFFD}").alias("replacement"))


def _heads_sql(source):
    return f"""SELECT doc_id, line_no, text FROM (SELECT *, min(line_no) FILTER (NOT {_HEAD}) OVER (PARTITION BY doc_id) AS a, max(line_no) FILTER (NOT {_HEAD}) OVER (PARTITION BY doc_id) AS z FROM {source}) WHERE line_no BETWEEN a AND z"""


@query("running_head_fixture", f"WITH {HEADS.sql} {_heads_sql('fx')}")
def running_head_fixture(spark, d):
    return au.without_running_heads(HEADS.df(spark), ["doc_id"])


@query("running_head_strip", f"SELECT doc_id, count(*) AS kept, min(line_no)::INT AS first, max(line_no)::INT AS last FROM ({_heads_sql(_LINES)}) GROUP BY doc_id")
def running_head_strip(spark, d):
    body = au.body_lines(F.split("text", "\n"))
    rows = table(spark, d, "documents").select("doc_id", body.alias("b")).where("b.first IS NOT NULL")
    return rows.select("doc_id", (F.col("b.last") - F.col("b.first") + 1).cast("long").alias("kept"), "b.first", "b.last")


@query("dot_leader_strip", rf"WITH {HEADS.sql} SELECT doc_id, line_no, regexp_replace(text, '[.·…]{{3,}}\s*\p{{Nd}}+\s*$', '') AS text FROM fx UNION ALL SELECT doc_id, line_no, regexp_replace(text, '[.·…]{{3,}}\s*\p{{Nd}}+\s*$', '') FROM {_LINES}")
def dot_leader_strip(spark, d):
    return HEADS.df(spark).union(_lines(spark, d)).select("doc_id", "line_no", t.without_leader(F.col("text")).alias("text"))


@query("toc_page_flag", rf"""WITH {HEADS.sql}, x AS (SELECT doc_id, regexp_replace(text, '[.·…]{{3,}}\s*\p{{Nd}}+\s*$', '') AS text FROM fx UNION ALL SELECT doc_id + 100, regexp_replace(text, '[.·…]{{3,}}\s*\p{{Nd}}+\s*$', '') FROM {_LINES})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(text, '[.·…]{{3,}}')) AS n_leaders, count(*) >= 6 AND count(*) FILTER (regexp_matches(text, '[.·…]{{3,}}')) >= 5 AS is_contents FROM x GROUP BY doc_id""")
def toc_page_flag(spark, d):
    rows = HEADS.df(spark).union(_lines(spark, d).withColumn("doc_id", F.col("doc_id") + 100)).select("doc_id", t.without_leader(F.col("text")).alias("text"))
    return au.contents_pages(rows, ["doc_id"])


WORDS = Literal("fx", "page int, ord int, text string, x0 double, top double", [(1, 1, "b", 20.0, 10.0), (1, 2, "a", 5.0, 10.4), (1, 3, "c", 1.0, 13.0), (1, 4, "d", 1.0, 7.5), (1, 5, "e", 1.0, 10.5), (2, 1, "z", 3.0, 1.5), (2, 2, "y", 3.0, 1.4)])


@query("word_lines", f"WITH {WORDS.sql} SELECT page, round_even(top / 3, 0)::BIGINT AS line, string_agg(text, ' ' ORDER BY x0, ord) AS text FROM fx GROUP BY ALL")
def word_lines(spark, d):
    return au.lines_from_words(WORDS.df(spark), ["page"])


@query("formula_pages", "SELECT doc_id, regexp_matches(text, '[=＝].*[a-zA-Zαβγφσ]|[∑∫√]') AS has_formula FROM documents")
def formula_pages(spark, d):
    return table(spark, d, "documents").select("doc_id", t.is_formula(F.col("text")).alias("has_formula"))


@query("latex_fragments", r"SELECT doc_id, len(regexp_extract_all(text, '\$\$?[^$]+\$\$?')) AS n FROM documents WHERE contains(text, '$')")
def latex_fragments(spark, d):
    return table(spark, d, "documents").where(F.col("text").contains("$")).select("doc_id", t.fragments(F.col("text")).cast("long").alias("n"))


TABLES = Literal("fx", "doc_id int, html string", [
    (1, '<table><tr><td colspan="2">a</td></tr><tr><td>b</td><td>c</td></tr></table>'), (2, "<table><thead><tr><th>x</th></tr></thead></table>"), (3, "<table></table>"),
    (4, '<table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table>'), (5, "<TABLE><TR><TD>a</TD></TR></TABLE>"), (6, "<table><tr></tr></table>\n<table>\n<tr><td>1</td>\n<td colspan=3>2</td></tr></table>"),
])
_SHAPES = r"""tabs AS (SELECT doc_id, unnest(regexp_extract_all(html, '(?s)<table.*?</table>')) AS tab, generate_subscripts(regexp_extract_all(html, '(?s)<table.*?</table>'), 1) AS pos FROM {src}),
rws AS (SELECT doc_id, pos, unnest(regexp_extract_all(tab, '(?s)<tr.*?</tr>')) AS r FROM tabs),
wid AS (SELECT doc_id, pos, coalesce(list_sum(list_transform(regexp_extract_all(r, '<t[dh]\b([^>]*)>', 1), lambda c: coalesce(TRY_CAST(nullif(regexp_extract(c, 'colspan\s*=\s*"?(\d+)', 1), '') AS INTEGER), 1))), 0) AS w FROM rws),
shp AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS tbl_no, n_rows, n_cols FROM (SELECT doc_id, pos, count(*)::INT AS n_rows, max(w)::INT AS n_cols FROM wid GROUP BY ALL))"""
_TREE = "(SELECT r_regionkey AS doc_id, '<table><tr><th colspan=\"2\">' || any_value(r_name) || '</th></tr>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', '' ORDER BY n_nationkey) || '</table>' AS html FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey)"


def _tree(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cell = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td>"), F.col("n_name"), F.lit("</td></tr>"))
    g = n.groupBy(F.col("r_regionkey").alias("doc_id")).agg(F.first("r_name").alias("r"), F.sort_array(F.collect_list(F.struct("n_nationkey", cell.alias("c")))).alias("rows"))
    return g.select("doc_id", F.concat(F.lit('<table><tr><th colspan="2">'), "r", F.lit("</th></tr>"), F.array_join(F.transform("rows", lambda x: x["c"]), ""), F.lit("</table>")).alias("html"))


def _shapes(df):
    return df.select("doc_id", F.posexplode(tb.shapes(F.col("html"))).alias("p", "s")).select("doc_id", (F.col("p") + 1).cast("long").alias("tbl_no"), "s.n_rows", "s.n_cols")


@query("table_shapes", f"WITH {TABLES.sql}, {_SHAPES.format(src='fx')} SELECT doc_id, tbl_no, n_rows, n_cols FROM shp")
def table_shapes(spark, d):
    return _shapes(TABLES.df(spark))


@query("table_pairing", f"""WITH {_SHAPES.format(src=_TREE)}, src AS (SELECT n_regionkey AS doc_id, 1 AS page, 1 AS tbl_no, (count(*) + CASE WHEN n_regionkey = 3 THEN 2 ELSE 1 END)::INT AS n_rows, 2 AS n_cols FROM nation GROUP BY n_regionkey)
SELECT s.doc_id, 1 AS tbl_no, s.page, s.n_rows || 'x' || s.n_cols AS src, shp.n_rows || 'x' || shp.n_cols AS md, (s.n_rows, s.n_cols) = (shp.n_rows, shp.n_cols) AS same FROM src s JOIN shp USING (doc_id)""")
def table_pairing(spark, d):
    src = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.count("*").alias("c"))
    src = src.select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("tbl_no"), (F.col("c") + F.when(F.col("doc_id") == 3, 2).otherwise(1)).cast("int").alias("n_rows"), F.lit(2).alias("n_cols"))
    return tb.pair(src, _shapes(_tree(spark, d)))


COUNTS = Literal("fx", "doc_id int, n_pages int, n_src int, n_md int, scanned boolean", [(1, 10, 0, 3, False), (2, 40, 0, 3, False), (3, 10, 2, 3, False), (4, 10, 3, 3, False), (5, 10, 0, 3, True), (6, 10, 2, 0, False), (7, 10, 0, 0, False)])


@query("table_findings", f"""WITH {COUNTS.sql} SELECT *, n_src <> n_md AND NOT scanned AND NOT (n_src = 0 AND n_md > 0) AS red,
CASE WHEN n_src = 0 AND n_md > 0 AND NOT scanned THEN CASE WHEN n_pages <= 30 THEN 'A' ELSE 'B' END WHEN n_src > 0 AND n_md > 0 THEN CASE WHEN n_src = n_md THEN 'paired' ELSE 'source_pages' END ELSE 'none' END AS pages_to FROM fx""")
def table_findings(spark, d):
    return tb.findings(COUNTS.df(spark))


@query("page_title_guess", r"""SELECT page_id, CASE WHEN lower(x) IN ('书名页','封面','扉页','版权页','cover','titlepage','title page','copyright','unknown','') THEN stem ELSE x END AS title FROM (
SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') AS x, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM pages)""")
def page_title_guess(spark, d):
    return table(spark, d, "pages").select("page_id", t.guessed_title(F.col("html"), t.stem(F.col("url"))).alias("title"))


@query("head_strip", "SELECT page_id, length(x) AS n, md5(x) AS digest FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<mbp:pagebreak[^>]*>', '<hr/>', 'g'), '(?is)<head[^>]*>.*?</head>', '', 'g') AS x FROM pages)")
def head_strip(spark, d):
    return table(spark, d, "pages").select("page_id", t.without_head(F.col("html")).alias("x")).select("page_id", F.length("x").cast("long").alias("n"), F.md5(F.encode("x", "utf-8")).alias("digest"))


@query("url_basename", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages")
def url_basename(spark, d):
    return table(spark, d, "pages").select("page_id", t.basename(F.col("url")).alias("name"))


@query("content_dedupe", "SELECT md5(text) AS digest, min(doc_id) AS first, count(*) AS copies, any_value(strlen(text))::BIGINT AS size FROM documents GROUP BY 1")
def content_dedupe(spark, d):
    return me.dedupe(table(spark, d, "documents"), F.encode("text", "utf-8"), "doc_id")


@query("dedupe_saving", "SELECT sum(copies)::BIGINT AS contents, count(*) AS kept, sum(size * (copies - 1))::BIGINT AS bytes_saved FROM (SELECT md5(text), count(*) AS copies, any_value(strlen(text)) AS size FROM documents GROUP BY 1)")
def dedupe_saving(spark, d):
    return me.dedupe(table(spark, d, "documents"), F.encode("text", "utf-8"), "doc_id").agg(F.sum("copies").alias("contents"), F.count("*").alias("kept"), F.sum(F.col("size") * (F.col("copies") - 1)).alias("bytes_saved"))


@query("first_seen_numbering", "SELECT source, digest, format('img_{:03d}.png', row_number() OVER (PARTITION BY source ORDER BY first)) AS name FROM (SELECT source, md5(text) AS digest, min(doc_id) AS first FROM documents GROUP BY ALL)")
def first_seen_numbering(spark, d):
    g = table(spark, d, "documents").groupBy("source", F.md5(F.encode("text", "utf-8")).alias("digest")).agg(F.min("doc_id").alias("first"))
    return numbered(g, ["source"], ["first"], "n").select("source", "digest", F.format_string("img_%03d.png", F.col("n")).alias("name"))


@query("audit_sample", "SELECT source, doc_id, rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('audit:' || source || ':' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 5")
def audit_sample(spark, d):
    return au.sample_pages(table(spark, d, "documents"), "source", "doc_id", 5).select("source", "doc_id", F.col("rn").cast("long").alias("rn"))


@query("quality_grade", """SELECT source, missing, errors, CASE WHEN missing = 0 AND errors = 0 THEN 'A' WHEN missing > 0 OR errors >= 3 THEN 'C' ELSE 'B' END AS grade FROM (
SELECT source, count(*) FILTER (n_chars < 20) AS missing, count(*) FILTER (toxic = 1) AS errors FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)""")
def quality_grade(spark, d):
    g = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count_if(F.col("n_chars") < 20).alias("missing"), F.count_if(F.col("toxic") == 1).alias("errors"))
    return g.withColumn("grade", au.grade(F.col("missing"), F.col("errors")))


FILES = Literal("fx", "path string, content string", [("a/x.pdf", "1"), ("b/x (1).pdf", "1"), ("b/x-2.pdf", "1"), ("b/x_3.pdf", "2"), ("y.pdf", "1")])


@query("original_match", rf"""WITH {FILES.sql}, k AS (SELECT path, regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', ''), '(?:\s*\(\d+\)|[-_ ]\d+)$', '') AS stem, md5(content) AS h FROM fx)
SELECT path, min(path) OVER (PARTITION BY stem, h) AS original FROM k""")
def original_match(spark, d):
    return au.original_of(FILES.df(spark).select("path", F.encode("content", "utf-8").alias("content")))


IMAGES = Literal("fx", "doc_id int, text string", [(1, "a ![x](data:image/png;base64,QUJD) b ![y](data:image/jpeg;base64,REVG) c ![z](data:image/png;base64,QU\nJD)"), (2, "none"), (3, "![s](data:image/svg+xml;base64,PHN2Zz4=) ![bad](data:image/png;base64,A)")])


@query("base64_extract", rf"""WITH {IMAGES.sql}, g AS (SELECT doc_id, regexp_extract_all(text, '{me.EMBEDDED}', 2) AS k, regexp_extract_all(text, '{me.EMBEDDED}', 3) AS dd FROM fx),
u AS (SELECT doc_id, unnest(k) AS k, regexp_replace(unnest(dd), '\s', '', 'g') AS b, generate_subscripts(k, 1) - 1 AS pos FROM g),
r AS (SELECT doc_id, pos, CASE lower(k) WHEN 'jpeg' THEN 'jpg' WHEN 'svg+xml' THEN 'svg' ELSE lower(k) END AS ext, from_base64(b) AS c FROM u WHERE length(b) % 4 = 0),
f AS (SELECT doc_id, c, min(pos) AS first, arg_min(ext, pos) AS fext FROM r GROUP BY ALL), n AS (SELECT *, format('img_{{:03d}}.{{}}', row_number() OVER (PARTITION BY doc_id ORDER BY first), fext) AS name FROM f)
SELECT r.doc_id, pos::INT AS pos, ext, md5(r.c) AS digest, octet_length(r.c) AS size, name FROM r JOIN n ON r.doc_id = n.doc_id AND r.c = n.c""")
def base64_extract(spark, d):
    return me.embedded_images(IMAGES.df(spark))


ASR = Literal("fx", "doc_id int, text string", [(1, "<|zh|><|NEUTRAL|>你好。"), (2, "  plain  "), (3, "<|en|>Hi <|x|> there<|>"), (4, "一。二。三"), (5, "行一。行二。\n第二行。还是它"), (6, "")])


@query("asr_tag_strip", rf"WITH {ASR.sql} SELECT doc_id, regexp_replace(regexp_replace(text, '<\|[^|]+\|>', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM fx")
def asr_tag_strip(spark, d):
    return ASR.df(spark).select("doc_id", t.without_asr_tags(F.col("text")).alias("text"))


@query("transcript_sentences", f"WITH {ASR.sql}, s AS (SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN string_split(text, chr(10)) ELSE regexp_extract_all(text, '[^。]+。?') END AS s FROM fx) SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1)::INT - 1 AS sentence_no FROM s")
def transcript_sentences(spark, d):
    return me.sentences(ASR.df(spark))


HOT = Literal("fx", "line_no int, text string", [(1, " A "), (2, ""), (3, "# c"), (4, "B"), (5, "  #d")])


@query("hotwords", f"WITH {HOT.sql} SELECT string_agg(trim(text), ' ' ORDER BY line_no) AS hotwords FROM fx WHERE trim(text) <> '' AND NOT starts_with(trim(text), '#')")
def hotwords(spark, d):
    return me.hotwords(HOT.df(spark))


EMBEDDED = Literal("fx", "doc_id int, text string", [*IMAGES.rows, (4, "![a b]( data:image/gif;base64,QUJD ) ![](data:image/PNG;base64,QUJD)"), (5, "![x](images/x.png) base64, but no image")])


@query("base64_rewrite", rf"""WITH {EMBEDDED.sql}, g AS (SELECT doc_id, text, regexp_split_to_array(text, '{me.EMBEDDED}') AS rest, regexp_extract_all(text, '{me.EMBEDDED}', 0) AS whole, regexp_extract_all(text, '{me.EMBEDDED}', 1) AS alt, regexp_extract_all(text, '{me.EMBEDDED}', 2) AS k, regexp_extract_all(text, '{me.EMBEDDED}', 3) AS dd FROM fx WHERE contains(text, 'base64,')),
u AS (SELECT doc_id, unnest(whole) AS whole, unnest(alt) AS alt, unnest(k) AS k, regexp_replace(unnest(dd), '\s', '', 'g') AS b, generate_subscripts(k, 1) AS pos FROM g),
r AS (SELECT *, CASE lower(k) WHEN 'jpeg' THEN 'jpg' WHEN 'svg+xml' THEN 'svg' ELSE lower(k) END AS ext FROM u WHERE length(b) % 4 = 0),
f AS (SELECT doc_id, b, min(pos) AS first, arg_min(ext, pos) AS fext FROM r GROUP BY ALL), n AS (SELECT *, format('img_{{:03d}}.{{}}', row_number() OVER (PARTITION BY doc_id ORDER BY first), fext) AS name FROM f),
p AS (SELECT u.doc_id, pos, coalesce('![' || alt || '](images/' || name || ')', whole) AS put FROM u LEFT JOIN n ON u.doc_id = n.doc_id AND u.b = n.b),
l AS (SELECT doc_id, list(put ORDER BY pos) AS put FROM p GROUP BY 1), t AS (SELECT g.doc_id, text AS before, rest[1] || array_to_string(list_transform(range(1, len(put) + 1), lambda i: put[i] || rest[i + 1]), '') AS text FROM g JOIN l USING (doc_id))
SELECT fx.doc_id, coalesce(t.text, fx.text) AS text, coalesce((SELECT count(*) FROM n WHERE n.doc_id = fx.doc_id), 0) AS n_images, strlen(fx.text)::BIGINT - strlen(coalesce(t.text, fx.text))::BIGINT AS saved FROM fx LEFT JOIN t USING (doc_id)""")
def base64_rewrite(spark, d):
    return me.rewritten(EMBEDDED.df(spark))


RECORDS = Literal("fx", "book int, rec int, data string", [(1, 1, "89504E470D"), (1, 2, "00112233"), (1, 3, "FFD8FFE0"), (1, 4, "424D"), (2, 1, "3C73766720"), (2, 2, "47494638"), (2, 3, ""), (2, 4, "474946")])


@query("image_records", f"""WITH {RECORDS.sql}, s AS (SELECT *, CASE {' '.join(f"WHEN starts_with(data, '{m}') THEN '{e}'" for m, e in me.MAGICS)} END AS ext FROM fx)
SELECT book, rec, format('img{{:04d}}.{{}}', row_number() OVER (PARTITION BY book ORDER BY rec), ext) AS name FROM s WHERE ext IS NOT NULL""")
def image_records(spark, d):
    rows = RECORDS.df(spark).withColumn("ext", me.sniffed(F.unhex("data"))).where("ext IS NOT NULL")
    return numbered(rows, ["book"], ["rec"], "n").select("book", "rec", F.format_string("img%04d.%s", "n", "ext").alias("name"))


@query("book_headers", "SELECT n_name, '# ' || n_name || chr(10) || chr(10) || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE '**作者：** ' || r_name || chr(10) || chr(10) END || '---' AS header FROM nation JOIN region ON n_regionkey = r_regionkey")
def book_headers(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_name", t.book_header(F.col("n_name"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("r_name"))).alias("header"))


REFS = Literal("fx", "doc_id int, html string", [(1, '<img src="kindle:embed:000Z?mime=image/jpg"/><img recindex="12" alt="x"/>'), (2, "<IMG SRC='kindle:embed:1'>"), (3, '<image recindex=7 />')])
NAMES = Literal("im", "doc_id int, recindex int, name string", [(1, 35, "img0035.jpg"), (1, 12, "img0012.png"), (2, 1, "img0001.gif")])


@query("image_ref_resolve", rf"""WITH {REFS.sql}, {NAMES.sql}, e AS (SELECT doc_id, list_concat(list_transform(regexp_extract_all(html, '(?i)<img[^>]*?src=["'']kindle:embed:([0-9A-Za-z]+)[^>]*>', 1),
lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda i: (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', upper(x[i])) - 1) * pow(36, length(x) - i)))::INT), list_transform(regexp_extract_all(html, '(?i)<(?:img|image)[^>]*?recindex=["'']?(\d+)["'']?[^>]*>', 1), lambda x: x::INT)) AS r FROM fx),
u AS (SELECT doc_id, unnest(r) AS recindex, generate_subscripts(r, 1)::INT - 1 AS pos FROM e)
SELECT doc_id, pos, recindex, coalesce(name, '') AS name FROM u LEFT JOIN im USING (doc_id, recindex)""")
def image_ref_resolve(spark, d):
    return me.image_refs(REFS.df(spark), NAMES.df(spark))


RANGES = Literal("fx", "a int, b int", [(0, 49), (None, 9), (5, None), (None, None)])


@query("page_range", f"WITH {RANGES.sql} SELECT a, b, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(a, 0) + 1) || '-' || coalesce((b + 1)::VARCHAR, 'r1') END AS pages FROM fx")
def page_range(spark, d):
    return RANGES.df(spark).select("a", "b", t.page_range(F.col("a"), F.col("b")).alias("pages"))


SELECTORS = Literal("fx", "s string, n int", [("1-5,8,r3-r1", 10), ("all", 4), ("r1", 3), ("2,2,9", 5), ("5-3", 9)])


@query("page_select", f"""WITH {SELECTORS.sql}, p AS (SELECT s, n, unnest(string_split(s, ',')) AS part FROM fx WHERE s <> 'all'),
e AS (SELECT s, n, string_split(trim(part), '-') AS x FROM p), v AS (SELECT s, n, list_transform(x, lambda y: CASE WHEN y[1] = 'r' THEN n + 1 - y[2:]::INT ELSE y::INT END) AS x FROM e),
a AS (SELECT s, n, unnest(range(x[1], x[-1] + 1)) AS k FROM v UNION ALL SELECT s, n, unnest(range(1, n + 1)) FROM fx WHERE s = 'all')
SELECT fx.s, fx.n, coalesce((SELECT string_agg(DISTINCT k::VARCHAR, ',' ORDER BY lpad(k::VARCHAR, 9, '0')) FROM a WHERE a.s = fx.s AND a.n = fx.n AND k BETWEEN 1 AND a.n), '') AS pages FROM fx""".replace("string_agg(DISTINCT k::VARCHAR, ',' ORDER BY lpad(k::VARCHAR, 9, '0'))", "array_to_string(list_sort(list(DISTINCT k)), ',')"))
def page_select(spark, d):
    return SELECTORS.df(spark).select("s", "n", F.array_join(t.selected_pages(F.col("s"), F.col("n")), ",").alias("pages"))


PATHS = Literal("fx", "path string, kind string", [("a/b.pdf", "pdf"), ("c.epub", "epub"), ("d.e.mobi", "mobi"), ("f.docx", "docx"), ("g_layout.pdf", "pdf"), ("h_content_list.json", "json"), ("i_middle.json", "json"), ("x_layout.md", "md"), ("j_model.pdf", "pdf"), ("k_span.pdf", "pdf")])


@query("output_paths", rf"WITH {PATHS.sql} SELECT path, regexp_replace(path, '\.[^./]*$', '') || CASE kind WHEN 'pdf' THEN '_converted' WHEN 'epub' THEN '_epub' WHEN 'mobi' THEN '_mobi' WHEN 'docx' THEN '_带目录.docx' END AS output, regexp_matches(path, '_(?:(?:layout|span|origin)\.pdf|(?:middle|model|content_list)\.json)$') AS prune_single, regexp_matches(path, '_(?:(?:layout|span|origin)\.pdf|(?:middle|model)\.json)$') AS prune_batch FROM fx")
def output_paths(spark, d):
    return PATHS.df(spark).select("path", t.output_path(F.col("path"), F.col("kind")).alias("output"), t.is_by_product(F.col("path"), False).alias("prune_single"), t.is_by_product(F.col("path"), True).alias("prune_batch"))


@query("bulk_estimate", "SELECT source, count(*) AS n_docs, sum(ceil(n_chars / 1000))::BIGINT AS n_pages, sum(ceil(n_chars / 1000)) / 100.0 AS minutes FROM documents GROUP BY source")
def bulk_estimate(spark, d):
    pages = F.sum(F.ceil(F.col("n_chars") / 1000))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), pages.cast("long").alias("n_pages"), (pages / 100.0).alias("minutes"))


@query("document_lines", f"SELECT doc_id, count(*) AS n_lines FROM {_LINES} GROUP BY doc_id")
def document_lines(spark, d):
    return sk.lines_of(table(spark, d, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("n_lines"))
