"""Getting this package to the Python workers of a cluster."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    path = os.path.join(tempfile.mkdtemp(prefix="folioframe"), "folioframe.zip")
    Path(path).write_bytes(held.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's folder for checkpoints: that in spark.checkpoint.dir, or a temporary one, on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="folioframe-checkpoints"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder for checkpoints and cut its lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a table from which on it is worth dealing.
DEAL_BYTES = 1 << 20


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the session has cores.

    A table of a few files is read in fewer splits than that, and its work would fall to one or two tasks. Larger tables have
    more splits than cores and stay as they are read, without a shuffle; tiny ones stay too.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < DEAL_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
