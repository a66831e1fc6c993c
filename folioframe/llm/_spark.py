"""What the operators need of a session: shared checkpoints, reading tables."""

from __future__ import annotations

import os

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from folioframe.runtime import checkpointed, dealt, ship

__all__ = ["checkpointed", "dealt", "mapped", "ship", "spread", "table"]


def mapped(shared: Broadcast, size: int) -> np.ndarray:
    """The bytes of a broadcast bytearray of ``size``, in a worker.

    Spark gives an executor one file for each broadcast variable; its workers share the file's pages instead of reading a copy each. Where
    there is no such file (encrypted sessions) or its bytes are not found, the value is read as usual.
    """
    path = getattr(shared, "_path", None)
    if path and os.path.exists(path) and size:
        raw = np.memmap(path, np.uint8, "r")
        at = raw[:64].tobytes().find(b"\x96" + size.to_bytes(8, "little")) + 9  # pickle's code for a bytearray, and its length
        if at >= 9 and len(raw) >= at + size:
            return raw[at : at + size]
    return np.frombuffer(shared.value, np.uint8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(spark: SparkSession) -> int:
    """Partitions for keyed groups: what the session sets for its shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
