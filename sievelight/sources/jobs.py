"""Run a per-file Python job on the executors, with this package at hand there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sievelight.session import BATCH_BYTES, RECOMMENDED

FILE_TASKS = "spark.sievelight.fileTasks"

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the Python workers, once per application; they get texts some MB at a time, unless the session has its own limit."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, RECOMMENDED[BATCH_BYTES])
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def per_file(rows: DataFrame, job: Callable, schema: str | StructType, tasks: int | None = None, held: bool = False, arrow: bool = False) -> DataFrame:
    """``mapInPandas`` (``arrow``: ``mapInArrow``) over rows that each name or hold one file.

    Rows that name a file are dealt to ``tasks`` tasks (``spark.sievelight.fileTasks``, or the number of shuffle
    partitions), since opening a file costs far more than its row. Rows that hold the bytes (``held``) are read where
    they lie unless ``tasks`` is given: moving them would cost more than the work. Nothing runs while the plan is built.
    """
    spark = rows.sparkSession
    ship_package(spark)
    if tasks is None and not held:
        tasks = int(spark.conf.get(FILE_TASKS, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks) if tasks else rows
    return rows.mapInArrow(job, schema) if arrow else rows.mapInPandas(job, schema)
