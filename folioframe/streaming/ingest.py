"""Continuous ingest with the batch operators: new files in, findings appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioframe.operators import skeleton


def documents(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of Markdown files: doc_id (path) and text."""
    return spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def audit_numbering(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Numbering issues of every arriving document, appended to ``out``. A document arrives whole, so each batch is complete in itself."""
    def run(batch: DataFrame, _: int) -> None:
        parsed = skeleton.parse_lines(skeleton.lines_of(batch))
        skeleton.issues(parsed, ["doc_id", "kind", "parent"]).write.mode("append").parquet(out)

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
