"""Sinks: reports, issues, books, images and records as files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.runtime import checkpointed


def report_text(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, report``: a document's report lines (section, ord, line) in order, one text."""
    ordered = F.sort_array(F.collect_list(F.struct("section", "ord", "line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("report"))


def write_text(rows: DataFrame, path: str, text: str = "md", by: str | None = None) -> None:
    """Texts as files, in a folder for each value of ``by``."""
    w = rows.select(*([by] if by else []), F.col(text).alias("value")).write.mode("overwrite")
    (w.partitionBy(by) if by else w).text(path)


def write_issues(issues: DataFrame, path: str) -> None:
    issues.write.mode("overwrite").json(path)


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Contents (binary) as files of ``folder``, a path or a URI that all executors reach; returns ``name, size`` of what was written.

    Each file is written whole under another name first and then renamed, so that a task that runs again leaves no half of one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            names, contents = b.column(0).to_pylist(), b.column(1).to_pylist()
            for n, c in zip(names, contents):
                part = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(c or b"")
                store.move(part, f"{root}/{n}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(c or b"") for c in contents], pa.int64())], ["name", "size"])

    written = rows.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInArrow(run, "name string, size long")
    return checkpointed(written)


def append_record(records: DataFrame, path: str) -> None:
    """Adds rows (book_id, section, seq, payload) to the reading archive; nothing is rewritten."""
    records.write.mode("append").partitionBy("book_id").parquet(path)


def transcript(segments: DataFrame) -> DataFrame:
    """``path, text``: a transcript's segments in order, a line each."""
    s = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return segments.groupBy("path").agg(F.array_join(F.transform(s, lambda x: x["text"]), "\n").alias("text"))
