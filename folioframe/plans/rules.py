"""Queries on parameter tables, headings, outlines, conversations and reading records."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import rules as ru
from folioframe.operators import structure as st
from folioframe.plans.registry import Literal, query, table

SOIL = Literal("fx", "layer_no int, name string, gamma double, c double, phi double, es double, fak double, thickness double, e double, w double, n double", [
    (1, "素填土", 18.5, 10.0, 12.0, 4.0, 90.0, 1.5, 0.9, 25.0, 5.0), (2, "粉质黏土", 19.2, 25.0, 15.0, 6.0, 160.0, 0.0, 0.8, 28.0, 8.0), (3, "淤泥质粉质黏土", 185.0, 12.0, 8.0, 3.0, 70.0, 3.0, 1.3, 45.0, 2.0),
    (4, "粉质黏土", 20.5, 30.0, 35.0, 7.0, 180.0, 2.5, 1.2, 26.0, 12.0), (5, "中砂", 19.5, 25.0, -8.0, 15.0, 220.0, 4.0, 0.7, None, 25.0), (7, "强风化岩", 23.5, -1.0, 38.0, 120.0, 1200.0, 5.0, None, None, 65.0), (7, "密实砂", 22.5, 0.0, 40.0, 3.0, 400.0, 2.0, 0.5, 15.0, 45.0),
])
RANGES = Literal("rg", ru.RANGE_SCHEMA.replace(", ", ","), [tuple(r) for r in ru.SOIL_RANGES])
METRICS = [r[0] for r in ru.SOIL_RANGES]
_LONG = "lng AS (SELECT layer_no, name, metric, value FROM (" + " UNION ALL ".join(f"SELECT layer_no, name, '{m}' AS metric, {m} AS value FROM fx" for m in METRICS) + ") WHERE value IS NOT NULL)"
_SEVERITY = "CASE WHEN coalesce(CASE WHEN metric IN ('c', 'phi') THEN value < err_at ELSE value <= err_at END, false) THEN 'certain' WHEN coalesce(value < sus_lo, false) OR coalesce(value > sus_hi, false) THEN 'suspicious' WHEN NOT value BETWEEN lo AND hi THEN 'review' ELSE 'ok' END"
_CHECKED = f"{SOIL.sql}, {RANGES.sql}, {_LONG}, chk AS (SELECT lng.*, lo, hi, {_SEVERITY} AS severity FROM lng JOIN rg USING (metric))"


def _checked(spark):
    return ru.check_ranges(ru.long_form(SOIL.df(spark), ["layer_no", "name"], METRICS), RANGES.df(spark))


@query("soil_range_check", f"WITH {_CHECKED} SELECT layer_no, name, metric, value, severity FROM chk")
def soil_range_check(spark, d):
    return _checked(spark).select("layer_no", "name", "metric", "value", "severity")


@query("soil_exempted", f"WITH {_CHECKED} SELECT layer_no, name, metric, CASE WHEN severity <> 'ok' AND regexp_matches(name, '{ru.ROCK}') THEN 'notice' ELSE severity END AS severity FROM chk")
def soil_exempted(spark, d):
    return ru.exempted(_checked(spark), F.col("name")).select("layer_no", "name", "metric", "severity")


@query("decimal_shift", f"WITH {_CHECKED} SELECT layer_no, metric, value, CASE WHEN severity = 'suspicious' THEN list_filter([value / 10, value / 100, value * 10], lambda x: x BETWEEN lo AND hi)[1] END AS hint FROM chk WHERE severity = 'suspicious'")
def decimal_shift(spark, d):
    return ru.decimal_hint(_checked(spark)).where("severity = 'suspicious'").select("layer_no", "metric", "value", "hint")


@query("column_shift", f"WITH {_CHECKED} SELECT metric, count(*) AS n, count(*) FILTER (severity <> 'ok') AS n_out, count(*) FILTER (severity <> 'ok') > count(*) * 0.25 AS shifted FROM chk GROUP BY metric")
def column_shift(spark, d):
    return ru.column_shift(_checked(spark), 0.25)


@query("soil_summary", f"WITH {_CHECKED} SELECT count(DISTINCT layer_no) AS n_layers, count(*) FILTER (severity = 'certain') AS n_certain, count(*) FILTER (severity = 'suspicious') AS n_suspicious, count(*) FILTER (severity = 'review') AS n_review FROM chk")
def soil_summary(spark, d):
    return ru.summary(_checked(spark), "layer_no")


@query("cross_rules", f"""WITH {SOIL.sql} SELECT layer_no, rule FROM (
SELECT layer_no, 'sand_with_cohesion' AS rule FROM fx WHERE contains(name, '砂') AND c > 10 UNION ALL SELECT layer_no, 'clay_with_large_phi' FROM fx WHERE regexp_matches(name, '黏土|粘土') AND phi > 30
UNION ALL SELECT layer_no, 'mud_with_large_gamma' FROM fx WHERE contains(name, '淤泥') AND gamma > 18 UNION ALL SELECT layer_no, 'gamma_against_e' FROM fx WHERE gamma > 20 AND e > 1.0
UNION ALL SELECT layer_no, 'soft_with_large_es' FROM fx WHERE contains(name, '淤泥') AND es > 10 UNION ALL SELECT layer_no, 'hard_with_small_es' FROM fx WHERE regexp_matches(name, '硬|密实') AND es < 4)""")
def cross_rules(spark, d):
    return ru.cross_rules(SOIL.df(spark))


@query("layer_numbers", f"WITH {SOIL.sql} SELECT (SELECT array_to_string(list_filter(range(min(layer_no), max(layer_no) + 1), lambda x: NOT list_contains(list(layer_no), x)), ',') FROM fx) AS missing, (SELECT string_agg(layer_no::VARCHAR, ',') FROM (SELECT layer_no FROM fx GROUP BY 1 HAVING count(*) > 1)) AS repeated")
def layer_numbers(spark, d):
    s = SOIL.df(spark)
    rep = s.groupBy("layer_no").count().where("count > 1").agg(F.array_join(F.sort_array(F.collect_list("layer_no")), ",").alias("repeated"))
    mis = s.agg(F.array_join(F.array_except(F.sequence(F.min("layer_no"), F.max("layer_no")), F.collect_set("layer_no")), ",").alias("missing"))
    return mis.withColumn("k", F.lit(1)).join(rep.withColumn("k", F.lit(1)), "k").drop("k")


_PART_RANGES = Literal("rg", ru.RANGE_SCHEMA.replace(", ", ","), [("p_size", 5.0, 40.0, 2.0, 49.0, 0.0), ("p_retailprice", 950.0, 1500.0, 920.0, 1800.0, None)])
_PART = f"{_PART_RANGES.sql}, lng AS (SELECT p_partkey, 'p_size' AS metric, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part), chk AS (SELECT p_partkey, metric, value, {_SEVERITY} AS severity FROM lng JOIN rg USING (metric))"


@query("range_check", f"WITH {_PART} SELECT p_partkey, metric, value, severity FROM chk WHERE severity <> 'ok'")
def range_check(spark, d):
    return ru.check_ranges(ru.long_form(table(spark, d, "part"), ["p_partkey"], ["p_size", "p_retailprice"]), _PART_RANGES.df(spark)).where("severity <> 'ok'").select("p_partkey", "metric", "value", "severity")


@query("range_check_summary", f"WITH {_PART} SELECT count(DISTINCT p_partkey) AS n_layers, count(*) FILTER (severity = 'certain') AS n_certain, count(*) FILTER (severity = 'suspicious') AS n_suspicious, count(*) FILTER (severity = 'review') AS n_review FROM chk")
def range_check_summary(spark, d):
    return ru.summary(ru.check_ranges(ru.long_form(table(spark, d, "part"), ["p_partkey"], ["p_size", "p_retailprice"]), _PART_RANGES.df(spark)), "p_partkey")


@query("monotonic_check", "SELECT o_orderkey, falls FROM (SELECT o_orderkey, coalesce(o_totalprice < lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), true) AS falls FROM orders)")
def monotonic_check(spark, d):
    return ru.monotonic(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice").select("o_orderkey", "falls")


BORING = Literal("fx", "hole int, layer int, bottom double, thickness double", [(1, 1, 3.5, 1.5), (1, 2, 1.2, 2.3), (1, 3, -0.8, 1.9), (1, 4, -0.5, 0.3), (2, 1, 4.0, 1.0), (2, 2, 2.995, 1.0), (2, 3, None, 2.0), (2, 4, 1.0, 1.0)])


@query("thickness_check", f"""WITH {BORING.sql}, b AS (SELECT *, lag(bottom) OVER (PARTITION BY hole ORDER BY layer) AS before FROM fx)
SELECT hole, layer, before IS NULL OR bottom < before AS falls, before IS NULL OR abs(before - bottom - thickness) <= 0.01 AS fits FROM b""")
def thickness_check(spark, d):
    return ru.monotonic(BORING.df(spark), "hole", "layer", "bottom", "thickness").select("hole", "layer", "falls", "fits")


@query("same_layer_conflicts", "SELECT l_partkey, l_suppkey, count(DISTINCT l_tax) AS n_values FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_tax) > 1")
def same_layer_conflicts(spark, d):
    return ru.conflicting(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_tax")


PARAS = Literal("fx", "doc_id int, para_no int, style string, text string", [
    (1, 1, "Normal", "1 编制依据"), (1, 2, "Normal", "2.1 项目概况"), (1, 3, "Normal", "3.1.2 成孔工艺"), (1, 4, "Normal", "第一章 编制依据"), (1, 5, "Normal", "一、编制依据"), (1, 6, "Normal", "（1）施工准备"),
    (1, 7, "Normal", "1.1项目概况"), (2, 1, "Heading 1", "1 x"), (2, 2, "标题 2", "1.1 y"), (2, 3, "Normal", "2 z"), (3, 1, "Normal", "1 " + "长" * 60), (3, 2, None, "plain"),
])
STYLES = Literal("sty", "doc_id int, style string", [(1, "标题 1"), (1, "Heading 2"), (1, "标题 2"), (2, "Heading 1")])
_HEADINGS = PARAS.sql + r""", hd AS (SELECT *, coalesce(starts_with(style, 'Heading') OR starts_with(style, '标题'), false) AS styled, regexp_extract(text, '^\s*(\d+(?:\.\d+)*)[\s、\.．]+\S', 1) AS num FROM fx),
hl AS (SELECT doc_id, para_no, style, text, styled, CASE WHEN NOT styled AND num <> '' AND length(trim(text)) <= 60 THEN length(regexp_replace(num, '[^.]', '', 'g')) + 1 END::INT AS level FROM hd)"""


@query("heading_levels", f"WITH {_HEADINGS} SELECT doc_id, para_no, styled, level FROM hl")
def heading_levels(spark, d):
    return st.headings(PARAS.df(spark)).select("doc_id", "para_no", "styled", "level")


@query("heading_census", f"""WITH {_HEADINGS} SELECT doc_id, count(*) FILTER (styled) AS n_styled, count(level) AS n_candidates, coalesce(string_agg(text, '|' ORDER BY para_no) FILTER (level IS NOT NULL), '') AS first,
CASE WHEN count(*) FILTER (styled) > 0 THEN 'insert' WHEN count(level) > 0 THEN 'suggest' ELSE 'stop' END AS action FROM hl GROUP BY doc_id""")
def heading_census(spark, d):
    return st.heading_census(st.headings(PARAS.df(spark)))


@query("style_fallback", f"WITH {_HEADINGS}, {STYLES.sql} SELECT hl.doc_id, para_no, level, coalesce(a.style, b.style) AS apply FROM hl LEFT JOIN sty a ON a.doc_id = hl.doc_id AND a.style = 'Heading ' || level LEFT JOIN sty b ON b.doc_id = hl.doc_id AND b.style = '标题 ' || level WHERE level <= 2")
def style_fallback(spark, d):
    return st.styled_levels(st.headings(PARAS.df(spark)), STYLES.df(spark), 2)


@query("page_anchor_fill", "SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM conversations")
def page_anchor_fill(spark, d):
    c = table(spark, d, "conversations").withColumn("page", F.when(F.col("role") != "assistant", F.col("turn")))
    return st.anchored(c, "conv_id", "turn", "page").select("conv_id", "turn", "anchor")


@query("first_speaker", "SELECT conv_id, arg_min(role, turn) AS speaker, arg_min(role, turn) = 'user' AS user_first FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def first_speaker(spark, d):
    return st.first_speakers(table(spark, d, "conversations"))


PHRASES = Literal("ph", "ord int, act int, phrase string", [(i, a, p) for i, (a, p) in enumerate(st.ACTS)] + [(90, 1, "the"), (91, 2, "der"), (92, 5, "que")])


@query("act_trigger", f"""WITH {PHRASES.sql}, u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user')
SELECT * FROM (SELECT conv_id, turn, CASE WHEN rn = 1 THEN 0 ELSE (SELECT arg_min(act, ord) FROM ph WHERE contains(u.text, phrase)) END AS act FROM u) WHERE act IS NOT NULL""")
def act_trigger(spark, d):
    return st.triggered_acts(table(spark, d, "conversations"), [(a, p) for _, a, p in PHRASES.rows])


@query("fragment_numbering", "SELECT conv_id, turn, '#' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS label FROM conversations WHERE role = 'assistant'")
def fragment_numbering(spark, d):
    from pyspark.sql import Window as W

    a = table(spark, d, "conversations").where("role = 'assistant'")
    return a.select("conv_id", "turn", F.concat(F.lit("#"), F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("string")).alias("label"))


CHAPTERS = Literal("ch", "book_id int, chapter int", [(1, 1), (1, 2), (1, 3), (2, 1)])
SAID = Literal("sd", "book_id int, chapter int", [(1, 2), (1, 2), (2, 1)])
RECORDS = Literal("rc", "book_id int, kind string, text string", [(1, "decision", "x"), (1, "note", "y"), (2, "note", "z"), (3, "hook", "短句"), (3, "hook", "很" * 31), (3, "compression", "a"), (3, "compression", "b")])
ARCHIVE = Literal("ar", "book_id int, section string, seq int, text string", [
    (1, "hook", 1, "它改变了我对时间的看法"), (1, "hook", 2, "很" * 31), (1, "interview", 1, "为" * 150), (1, "compression", 2, "第二章" + "乙" * 80), (1, "compression", 1, "第一章" + "甲" * 120), (1, "concept", 1, "概念一"), (1, "concept", 2, "概念二"), (1, "debate", 1, "反驳"),
    (1, "life", 1, "一次经历"), (1, "fragment", 1, "碎片"), (1, "decision", 1, "决定"), (1, "experiment", 2, "试一次"), (2, "compression", 1, "短"), (2, "debate", 1, "认同"), (2, "other", 1, "不进稿"), (3, "hook", 1, "很" * 31),
])


@query("recall_check", f"WITH {CHAPTERS.sql}, {SAID.sql} SELECT book_id, chapter, CASE WHEN EXISTS (SELECT 1 FROM sd WHERE (sd.book_id, sd.chapter) = (ch.book_id, ch.chapter)) THEN 'remembered' ELSE 'forgotten' END AS state FROM ch")
def recall_check(spark, d):
    return st.recall(CHAPTERS.df(spark), SAID.df(spark))


@query("closing_check", f"WITH {RECORDS.sql} SELECT book_id, count(*) FILTER (kind IN ('decision', 'rule', 'checklist', 'experiment')) >= 1 AS done FROM rc GROUP BY book_id")
def closing_check(spark, d):
    return st.closing(RECORDS.df(spark))


BLOCKS = Literal("bk", "block int, title string, section string", [(n, title, section) for n, title, sections in st.DRAFT_BLOCKS for section in sections])


def _draft(most):
    return f"""WITH {ARCHIVE.sql}, {BLOCKS.sql}, b AS (SELECT book_id, block, title, string_agg(text, chr(10) ORDER BY section, seq) AS body FROM ar JOIN bk USING (section) WHERE section <> 'hook' OR length(text) <= 30 GROUP BY ALL)
SELECT book_id, block, title, body, length(body)::BIGINT AS n_chars, length(body) > {most} AS too_long FROM b"""


@query("draft_blocks", _draft(200))
def draft_blocks(spark, d):
    return st.draft(ARCHIVE.df(spark), "page")


@query("draft_blocks_full", _draft(430))
def draft_blocks_full(spark, d):
    return st.draft(ARCHIVE.df(spark), "full")


@query("draft_gaps", f"WITH {ARCHIVE.sql}, {BLOCKS.sql}, b AS (SELECT DISTINCT book_id, block FROM ar JOIN bk USING (section) WHERE section <> 'hook' OR length(text) <= 30) SELECT x.book_id, y.block, y.title FROM (SELECT DISTINCT book_id FROM ar) x, (SELECT DISTINCT block, title FROM bk) y WHERE NOT EXISTS (SELECT 1 FROM b WHERE (b.book_id, b.block) = (x.book_id, y.block))")
def draft_gaps(spark, d):
    return st.draft_gaps(ARCHIVE.df(spark))


@query("outline_numbering", "SELECT n_name, dense_rank() OVER (ORDER BY n_regionkey) || '.' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS number FROM nation")
def outline_numbering(spark, d):
    return st.numbered_tree(table(spark, d, "nation").select("n_regionkey", "n_name"), "n_regionkey", "n_name").select("n_name", "number")


OUTLINE = Literal("fx", "doc_id int, line_no int, text string", [(1, 1, "1 编制依据"), (1, 2, "  → 列规范"), (1, 3, "1.1.1.1 too deep"), (1, 4, "第一章"), (1, 5, "这里是一段不该出现在目录里的正文内容" * 3), (1, 6, "2.1 项目概况"), (1, 7, ""), (1, 8, "【本方案的特殊章节】")])


@query("outline_lint", rf"""WITH {OUTLINE.sql}, s AS (SELECT *, trim(text) AS s FROM fx WHERE trim(text) <> '')
SELECT doc_id, line_no, fault FROM (SELECT *, CASE WHEN regexp_matches(s, '^\d+(?:\.\d+){{3,}}') THEN 'too_deep' WHEN NOT starts_with(s, '→') AND NOT regexp_matches(s, '^\s*\d{{1,2}}(?:\.\d{{1,2}}){{0,2}}\s+\S') AND NOT starts_with(s, '【') THEN CASE WHEN length(s) > 40 THEN 'body_text' ELSE 'not_numbered' END END AS fault FROM s) WHERE fault IS NOT NULL""")
def outline_lint(spark, d):
    return st.outline_lint(OUTLINE.df(spark))


# fixed values: chapters of two kinds of document, and what a kind of project adds
TEMPLATES = Literal("tp", "doc_type string, chapter int, title string", [("construction", i, x) for i, x in enumerate("编制依据 工程概况 施工部署 施工进度计划 主要分项工程施工工艺 质量保证措施 安全文明施工措施 季节性施工措施 监测方案 应急预案 附图附表".split(), 1)] + [("monitoring", i, x) for i, x in enumerate("编制依据 工程概况与周边环境 监测目的与依据 监测项目及测点布置 监测方法与仪器设备 监测频率 监测报警值与控制标准 数据处理与信息反馈 异常情况处理措施 监测组织与质量保证 附图".split(), 1)])
EXTRAS = Literal("ex", "project string, title string", [("基坑支护", "降水/止水"), ("基坑支护", "基坑变形控制"), ("桩基", "试桩"), ("桩基", "桩基检测"), ("边坡", "坡面排水"), ("降水", "抽水试验"), ("管廊/沟槽", "沟槽支护"), ("钢栈桥/平台", "承载力试验")])
JOBS = Literal("jb", "job int, doc_type string, project string, scale string, audience string", [(1, "construction", "桩基", "大", "专家"), (2, "monitoring", "基坑支护", None, "业主"), (3, None, "边坡", "小", "监理")])


@query("extra_chapters", f"WITH {JOBS.sql}, {TEMPLATES.sql}, {EXTRAS.sql} SELECT job, chapter, title FROM (SELECT job, chapter, title FROM jb JOIN tp USING (doc_type) UNION ALL SELECT job, NULL, title FROM jb JOIN ex USING (project))")
def extra_chapters(spark, d):
    j = JOBS.df(spark)
    base = j.join(F.broadcast(TEMPLATES.df(spark)), "doc_type").select("job", "chapter", "title")
    return base.union(j.join(F.broadcast(EXTRAS.df(spark)), "project").select("job", F.lit(None).cast("int"), "title"))


@query("intake_gate", f"WITH {JOBS.sql} SELECT job, concat_ws(',', CASE WHEN doc_type IS NULL THEN 'doc_type' END, CASE WHEN project IS NULL THEN 'project' END, CASE WHEN scale IS NULL THEN 'scale' END, CASE WHEN audience IS NULL THEN 'audience' END) AS ask FROM jb")
def intake_gate(spark, d):
    return JOBS.df(spark).select("job", F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("doc_type", "project", "scale", "audience")]).alias("ask"))


ROUTES = Literal("rt", "kind string, route string, look_at string", st.ROUTES)


@query("route_by_source", f"WITH {ROUTES.sql}, k AS (SELECT doc_id, CASE WHEN n_chars < 100 THEN 'scan' WHEN lang = 'en' THEN 'docx' ELSE 'text_pdf' END AS kind FROM documents) SELECT doc_id, route, look_at FROM k JOIN rt USING (kind)")
def route_by_source(spark, d):
    k = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") < 100, "scan").when(F.col("lang") == "en", "docx").otherwise("text_pdf").alias("kind"))
    return k.join(F.broadcast(ROUTES.df(spark)), "kind").select("doc_id", "route", "look_at")


KINDS = Literal("ek", "kind string, stars int", st.ERROR_KINDS)
CLASSES = Literal("tc", "class string, tier string", st.TIERS_BY_CLASS)


@query("error_taxonomy", f"WITH {KINDS.sql}, {CLASSES.sql} SELECT 'error' AS t, kind AS k, stars::VARCHAR AS v FROM ek UNION ALL SELECT 'tier', class, tier FROM tc")
def error_taxonomy(spark, d):
    return KINDS.df(spark).select(F.lit("error").alias("t"), F.col("kind").alias("k"), F.col("stars").cast("string").alias("v")).union(CLASSES.df(spark).select(F.lit("tier"), "class", "tier"))


@query("narrative_split", r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?s)<table|^\s*\|.*\|\s*$') THEN 'table' ELSE 'narrative' END AS part, regexp_matches(text, '(?s)<table|^\s*\|.*\|\s*$') AS confirm FROM documents")
def narrative_split(spark, d):
    return st.split_tables(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "part", "confirm")


READ = Literal("rd", "book_id int, chapter int, mode string, label string, compression string", [
    (1, 1, "read", None, "a"), (1, 2, "skim", st.SKIMMED, None), (1, 3, "skim", None, None), (2, 1, "skim", st.SKIMMED, "b"), (2, 2, "read", st.SKIMMED, "c"), (2, 3, None, None, None),
])


@query("skim_labels", f"""WITH {READ.sql} SELECT * FROM (SELECT book_id, chapter, CASE WHEN mode = 'skim' AND coalesce(label, '') <> '{st.SKIMMED}' THEN 'label_missing'
WHEN mode = 'skim' AND compression IS NOT NULL THEN 'compressed_though_skimmed' WHEN mode <> 'skim' AND label = '{st.SKIMMED}' THEN 'label_without_skimming' END AS finding FROM rd) WHERE finding IS NOT NULL""")
def skim_labels(spark, d):
    return st.skimming(READ.df(spark))


MENTIONS = Literal("mn", "book_id int, seq int, title string, relation string", [(1, 1, "B", "collateral"), (1, 2, "A", "direct"), (1, 3, "B", "direct"), (1, 4, "X", "direct"), (2, 1, "A", "collateral"), (2, 2, "C", "direct")])
KNOWN = Literal("kn", "title string, author string", [("A", "a"), ("B", "b"), ("C", "c"), ("D", "d")])


@query("related_books", f"""WITH {MENTIONS.sql}, {KNOWN.sql}, f AS (SELECT * FROM mn QUALIFY row_number() OVER (PARTITION BY book_id, title ORDER BY seq) = 1)
SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY relation <> 'direct', seq, title))::INT AS place, title, relation, author FROM f JOIN kn USING (title)""")
def related_books(spark, d):
    return st.reading_queue(MENTIONS.df(spark), KNOWN.df(spark))


@query("merge_parts", r"""WITH p AS (SELECT conv_id AS doc_id, turn, text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role <> 'system')
SELECT doc_id, count(*)::INT AS n_parts, bool_and(before IS NULL OR turn = before + 1) AS contiguous, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM p GROUP BY doc_id""")
def merge_parts(spark, d):
    turns = table(spark, d, "conversations").where("role <> 'system'")
    return st.merged_parts(turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("first_page"), F.col("turn").alias("last_page"), "text"))
