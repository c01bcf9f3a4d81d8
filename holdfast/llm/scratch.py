"""Tables in the shared folder: lineage ends there and a lost executor loses nothing."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from types import ModuleType
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from holdfast.scale import checkpoint_folder

# Texts handed to Python at once; with long documents the default of 10,000 rows is too much memory.
TEXTS_PER_BATCH = 256
# Spark's setting by which the shuffle files of a statement go when it has ended, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the checkpoint folder; the cluster cleans that folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/llm-{purpose}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write once, read afterwards; a reader sees only the columns and row groups it needs.

    Nothing reads the shuffles behind the table any more; their files go as soon as it is written.
    """
    spark = frame.sparkSession
    path = new_folder(spark, purpose)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def dropped(frame: DataFrame) -> None:
    """Delete a stored table that no later step reads."""
    spark = frame.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Python workers get few whole texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS_PER_BATCH:
        spark.conf.set(name, str(TEXTS_PER_BATCH))


def once(key: tuple, build: Callable[[], Any]) -> Any:
    """A value kept by the Python process, as tasks bring their functions with them and those begin empty.

    The process outlives a stage; values of another kind (the key's first part) belong to an earlier one and are let go.
    """
    kept = sys.modules.setdefault("_holdfast_worker", ModuleType("_holdfast_worker")).__dict__
    if key not in kept:
        for other in [k for k in kept if isinstance(k, tuple) and k[0] != key[0]]:
            del kept[other]
        kept[key] = build()
    return kept[key]
