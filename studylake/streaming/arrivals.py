"""EAV exports that keep arriving in a folder, collected into one Parquet table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.sources.readers import scan_eav_csv


def arriving_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the paths of CSV files as they land; nothing of them is read."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch)
    return files.schema(schema).load(folder).select("path")


def first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """`path, header` of text files. Only the first block of a file is looked at, line by line, so a file may be of any size."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), "value",
        F.monotonically_increasing_id().alias("_at"),
    )
    # A block is read in order by one task, so its first line has the smallest number.
    return lines.where("_start = 0").groupBy("path").agg(F.min_by("value", "_at").alias("header"))


def collect_exports(spark: SparkSession, folder: str, target: str, checkpoint: str, files_per_batch: int = 1000):
    """Append the `record, field_name, value` rows that have arrived to the table at `target`, then stop.

    Columns are found by each file's header, so their order and further columns do not matter; a file without one of the three
    stops the stream. Each batch replaces its own partition, so a batch that is retried after a failure is not counted twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        by_header: dict[str, list[str]] = {}
        paths = [row.path for row in batch.collect()]  # at most `files_per_batch` names, then as many headers
        for row in first_lines(batch.sparkSession, paths).collect() if paths else []:
            by_header.setdefault(row.header, []).append(unquote(row.path))
        rows = [scan_eav_csv(batch.sparkSession, paths) for _, paths in sorted(by_header.items())]
        if rows:
            reduce(DataFrame.unionByName, rows).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        arriving_files(spark, folder, files_per_batch).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def collected_exports(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).select(*[F.col(name) for name in ("record", "field_name", "value")])
