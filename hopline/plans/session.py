"""Session settings the plans rely on."""

from __future__ import annotations

from hopline.plans.limits import DEFAULT_LIMITS, Limits


#: What one shuffle partition should hold, so that a task sorts it in memory.
PARTITION_BYTES = 128_000_000


def recommended_settings(limits: Limits = DEFAULT_LIMITS, input_bytes: int | None = None) -> dict[str, str]:
    """Settings for ``SparkSession.builder.config``; results do not depend on them.

    Adaptive execution sizes shuffle partitions and splits skewed ones. The ``IN``
    threshold lets a frontier's literal list reach the Parquet reader as single
    values instead of one wide range. With ``input_bytes`` (of the largest table, say)
    shuffles begin with as many partitions as that takes, and adaptive execution draws
    small ones together again; 200 partitions of 100 TB would be 500 GB each.
    """
    sized = {}
    if input_bytes is not None:
        partitions = max(200, -(-input_bytes // PARTITION_BYTES))
        sized = {
            "spark.sql.shuffle.partitions": str(partitions),
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        }
    return sized | {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.pushdown.inFilterThreshold": str(limits.literal_rows),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
