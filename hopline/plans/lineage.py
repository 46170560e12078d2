"""Shared storage for lineage cuts and scratch tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from hopline.plans.limits import DEFAULT_LIMITS, Limits


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster the setting is required, because executors must all reach it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="hopline-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/hopline/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was computed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Has Spark remove the shuffle files of a query when the query ends.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_clean(df: DataFrame) -> DataFrame:
    """As ``cut``, and the shuffle files of ``df`` go as soon as it is stored.

    Otherwise they stay until the driver's heap happens to fill, so that a query of many
    steps may hold the files of all its steps at once. Only this one run of ``df`` is
    concerned: what else is made of it computes it anew, as ever.
    """
    conf = df.sparkSession.conf
    before = conf.get(FILES_GO, None)
    conf.set(FILES_GO, "true")
    try:
        return cut(df.select("*"))
    finally:
        if before is None:
            conf.unset(FILES_GO)
        else:
            conf.set(FILES_GO, before)


def release(spark: SparkSession) -> None:
    """Have Spark look for checkpoints that nothing refers to any more, as it else does when the driver's heap is full.

    It removes them only with ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@dataclass(frozen=True)
class Settled:
    """A materialised table whose exact row count is known.

    ``head`` holds the rows themselves when there are few of them.
    """

    df: DataFrame
    rows: int
    head: list[Row] | None

    def literals(self, column: str) -> list | None:
        """Distinct values of ``column``, or None when the table is not small."""
        if self.head is None:
            return None
        return sorted({row[column] for row in self.head})


def settle(df: DataFrame, limits: Limits = DEFAULT_LIMITS) -> Settled:
    """Materialise ``df`` and learn its size, bringing back at most a few rows."""
    done = cut(df)
    head = done.limit(limits.literal_rows + 1).collect()
    if len(head) <= limits.literal_rows:
        return Settled(done, len(head), head)
    return Settled(done, done.count(), None)
