"""Sources: files as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators.ebook import decoded, docx_paragraphs
from folioframe.runtime import ship


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: Markdown files under ``path``, whole; bytes that are no UTF-8 are replaced."""
    ship(spark)
    return binary(spark, path, "*.md").mapInArrow(_replacing, "path string, text string")


def _replacing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode("utf-8", "replace") for x in b.column(1).to_pylist()], pa.string())], ["path", "text"])


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, content`` of all files below ``path`` whose names match."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def discovered(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """Paths of outputs below ``path``, in order."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length").orderBy("path")


def with_fallback(files: DataFrame) -> DataFrame:
    """``path, text``: bytes decoded as utf-8, utf-16, gb18030, or utf-8 without what does not fit."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else decoded(x) for x in b.column(1).to_pylist()], pa.string())], ["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")


def docx(files: DataFrame) -> DataFrame:
    """``path, para_no, style, text`` of DOCX files."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": p, "para_no": n, "style": s, "text": t} for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, s, t in docx_paragraphs(x)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("para_no", pa.int32()), ("style", pa.string()), ("text", pa.string())]))

    return files.select("path", "content").mapInArrow(run, "path string, para_no int, style string, text string")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """``path, seq, text, timestamp``: speech segments of JSON files; timestamps stay JSON text."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "array<struct<text: string, timestamp: string>>").alias("s"))
    return raw.select("path", F.posexplode("s").alias("seq", "x")).select("path", "seq", "x.text", "x.timestamp")


def layout(spark: SparkSession, path: str) -> DataFrame:
    """``path, block_no, page_idx, type, text`` of layout lists."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "array<struct<type: string, text: string, page_idx: int>>").alias("b"))
    return raw.select("path", F.posexplode("b").alias("block_no", "x")).select("path", "block_no", "x.page_idx", "x.type", "x.text")
