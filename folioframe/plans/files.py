"""Queries that write files and read them back: sinks and sources together. Files go below the folder for checkpoints, which all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioframe.operators import skeleton as sk
from folioframe.plans.books import docx_bytes
from folioframe.plans.numbering import LINES
from folioframe.plans.registry import Literal, query, table
from folioframe.runtime import checkpoint_dir
from folioframe.sources import files, sinks


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/files-{name}-{uuid.uuid4().hex}"


_MD = "SELECT n_nationkey, n_name, '# ' || n_name || chr(10) || n_nationkey || '.1 text' AS text FROM nation"


def _written(spark, d, name):
    folder = _folder(spark, name)
    n = table(spark, d, "nation").select(F.concat("n_name", F.lit(".md")).alias("name"), F.encode(F.concat(F.lit("# "), "n_name", F.lit("\n"), F.col("n_nationkey").cast("string"), F.lit(".1 text")), "utf-8").alias("content"))
    return folder, sinks.write_files(n, folder)


@query("markdown_files", f"SELECT n_name || '.md' AS name, text FROM ({_MD})")
def markdown_files(spark, d):
    folder, _ = _written(spark, d, "md")
    return files.markdown(spark, folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "text")


@query("discovered_files", f"SELECT n_name || '.md' AS name, strlen(text)::BIGINT AS length FROM ({_MD})")
def discovered_files(spark, d):
    folder, _ = _written(spark, d, "found")
    return files.discovered(spark, folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length")


@query("written_files", f"SELECT n_name || '.md' AS name, strlen(text)::BIGINT AS size FROM ({_MD})")
def written_files(spark, d):
    return _written(spark, d, "sizes")[1]


@query("docx_paragraphs", "SELECT r_name AS doc, row_number() OVER (PARTITION BY r_name ORDER BY n_name)::INT AS para_no, CASE WHEN row_number() OVER (PARTITION BY r_name ORDER BY n_name) = 1 THEN 'Heading 1' ELSE 'Normal' END AS style, n_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def docx_paragraphs(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = n.groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names")).collect()  # five regions
    made = spark.createDataFrame([(r["r_name"], bytearray(docx_bytes([("" if k else "h1", x) for k, x in enumerate(r["names"])]))) for r in g], "doc string, content binary")
    return files.docx(made.withColumnRenamed("doc", "path")).withColumnRenamed("path", "doc")


@query("issue_files", "SELECT doc_id, kind, parent, type, ordinals, lo, hi FROM (VALUES (1, 'clause', '4.1', 'missing', '3', 1, 4), (2, 'clause', '11.9', 'suspect', '28', 1, 3), (3, '图', '6.2', 'suspect', '15', 10, 11), (4, '图', '6.2', 'missing', '12,13,14', 10, 17), (9, 'clause', 'A.0', 'missing', '2', 1, 3)) t(doc_id, kind, parent, type, ordinals, lo, hi)")
def issue_files(spark, d):
    folder = _folder(spark, "issues")
    parsed = sk.parse_lines(LINES.df(spark))
    sinks.write_issues(sk.issues(parsed, ["doc_id", "kind", "parent"]), folder)
    return spark.read.schema("doc_id int, kind string, parent string, type string, ordinals string, lo int, hi int").json(folder)


@query("archive_files", "SELECT n_regionkey AS book_id, 'notes' AS section, n_nationkey AS seq, n_name AS payload FROM nation UNION ALL SELECT n_regionkey, 'rules', n_nationkey, upper(n_name) FROM nation")
def archive_files(spark, d):
    folder = _folder(spark, "archive")
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("book_id"), F.lit("notes").alias("section"), F.col("n_nationkey").alias("seq"), F.col("n_name").alias("payload"))
    sinks.append_record(n, folder)
    sinks.append_record(n.withColumn("section", F.lit("rules")).withColumn("payload", F.upper("payload")), folder)
    return spark.read.schema("section string, seq int, payload string, book_id int").parquet(folder)


_JSON = Literal("fx", "name string, seq int, text string, stamp string", [("a", 0, "one。", "[[0,1]]"), ("a", 1, "two", None), ("b", 0, "x", "[[5,9],[9,12]]")])


def _json(spark, name, make):
    folder = _folder(spark, name)
    rows = _JSON.df(spark).groupBy("name").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text", "stamp"))), make)).alias("value"))
    sinks.write_text(rows, folder, "value", by="name")
    return folder


@query("segment_files", f"WITH {_JSON.sql} SELECT name, seq, text, stamp AS timestamp FROM fx")
def segment_files(spark, d):
    folder = _json(spark, "segments", lambda x: F.struct(x["text"].alias("text"), F.from_json(x["stamp"], "array<array<bigint>>").alias("timestamp")))
    return files.segments(spark, folder).select(F.regexp_extract("path", "name=([^/]*)", 1).alias("name"), "seq", "text", "timestamp")


@query("transcript_files", f"WITH {_JSON.sql} SELECT name, string_agg(text, chr(10) ORDER BY seq) AS text FROM fx GROUP BY name")
def transcript_files(spark, d):
    folder = _json(spark, "transcripts", lambda x: F.struct(x["text"].alias("text")))
    return sinks.transcript(files.segments(spark, folder)).select(F.regexp_extract("path", "name=([^/]*)", 1).alias("name"), "text")


@query("layout_files", f"WITH {_JSON.sql} SELECT name, seq AS block_no, seq * 2 AS page_idx, 'text' AS type, text FROM fx")
def layout_files(spark, d):
    folder = _json(spark, "layout", lambda x: F.struct(F.lit("text").alias("type"), x["text"].alias("text"), (x["seq"] * 2).alias("page_idx")))
    return files.layout(spark, folder).select(F.regexp_extract("path", "name=([^/]*)", 1).alias("name"), "block_no", "page_idx", "type", "text")


@query("report_files", "SELECT l_orderkey AS doc_id, string_agg(l_linenumber || ' ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) AS report FROM lineitem GROUP BY l_orderkey")
def report_files(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("section"), F.lit(1).alias("ord"), F.concat_ws(" ", F.col("l_linenumber").cast("string"), "l_returnflag").alias("line"))
    return sinks.report_text(lines)
