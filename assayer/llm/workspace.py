"""Where intermediate tables go, and how executors get this package.

Lineage is cut by writing a table into the folder that the session names in
``spark.checkpoint.dir``; driver and executors share it. A lost executor costs
at most the tasks of the stage that is running, as its inputs are files.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources import shared
from ..sources.shared import materialise, new_path, quoted, shared_dir

__all__ = ["join_apart", "materialise", "new_path", "quoted", "shared_dir", "ship", "trim"]

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def join_apart(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that never sends a side through the driver. A broadcast does, and each one holds megabytes there however
    few its rows are, until garbage is collected; steps that join in many rounds would fill the driver with them."""
    return left.join(right.hint("merge"), on, how)


def trim() -> None:
    """Give memory that is free in this process back to the system: a worker that Spark keeps holds what earlier stages used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Arrow batches hold whole texts here, several times over on their way; unless
    the session names another size than Spark's default, they are kept at 16 MB.
    """
    if spark.conf.get(BATCH_BYTES, None) == "67108864b":
        spark.conf.set(BATCH_BYTES, "16m")
    shared.ship(spark)
