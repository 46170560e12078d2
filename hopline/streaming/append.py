"""Load a folder of files chunk by chunk into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def append_arrivals(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    progress: str,
    files_per_chunk: int = 1_000,
) -> DataFrame:
    """Append every Parquet file under ``source`` not loaded before to ``target``.

    Files go in as micro-batches; ``progress`` remembers them, so a restarted load
    continues where it stopped and files are taken once. Returns the target table.
    """
    arriving = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_chunk)
        .parquet(source)
    )
    load = (
        arriving.writeStream.format("parquet")
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start(target)
    )
    load.awaitTermination()
    return spark.read.schema(schema).parquet(target)
