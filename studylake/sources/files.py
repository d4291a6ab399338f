"""File manifests: digests, formats and lake paths of whole folders."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studylake.functions.names import legal_name, version_suffix
from studylake.operators.catalog import next_versions
from studylake.session import local_rows

# Files up to this size are read as one cell; larger ones are hashed as a stream.
CELL_BYTES = 256 * 1024 * 1024
CHUNK = 8 * 1024 * 1024

# File extensions and their EDAM format ids.
EDAM_FORMATS = {
    "csv": "http://edamontology.org/format_3752",
    "tsv": "http://edamontology.org/format_3475",
    "json": "http://edamontology.org/format_3464",
    "xml": "http://edamontology.org/format_2332",
    "txt": "http://edamontology.org/format_2330",
}


def empty_files(files: DataFrame) -> DataFrame:
    """`path` of the files without bytes, which a scan lists but passes over: those that give no row."""
    # Both spell a path without a host in their own way.
    listed = local_rows(files.sparkSession, [(re.sub("^([^:/]+):///", r"\1:/", unquote(uri)),) for uri in files.inputFiles()], "path string")
    return listed.join(files.select("path"), "path", "left_anti")


def scan_files(spark: SparkSession, path: str, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """`storage_uri, file_name, extension, length, digest` of every file below `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= cell_bytes).select("path", "length", F.sha2("content", 256).alias("digest"))
    large = files.where(F.col("length") > cell_bytes).select("path", "length")
    streamed = large.repartition("path").mapInPandas(_streamed_hash(CHUNK), "path string, length bigint, digest string")
    name = F.substring_index("path", "/", -1)
    extension = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    nothing = hashlib.sha256(b"").hexdigest()
    empty = empty_files(files).select("path", F.lit(0).cast("bigint").alias("length"), F.lit(nothing).alias("digest"))
    return small.unionByName(streamed).unionByName(empty).select(
        F.col("path").alias("storage_uri"), name.alias("file_name"), extension.alias("extension"), "length", "digest"
    )


def _streamed_hash(chunk_bytes: int):
    """Digest of files read piece by piece. The function is made here so that it travels to the workers by value."""

    def hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            digests = []
            for uri in batch["path"]:
                filesystem, location = fs.FileSystem.from_uri(quote(uri, safe="/:@"))
                digest = hashlib.sha256()
                with filesystem.open_input_stream(location) as stream:
                    while chunk := stream.read(chunk_bytes):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield batch.assign(digest=digests)

    return hash_files


def file_manifest(
    files: DataFrame, assets: DataFrame, versions: DataFrame, study: str, bump: str = "patch", edam_format: str | None = None
) -> DataFrame:
    """Files with the asset they belong to, their next version and their path in the lake.

    The asset name is the strict legal name of the file name without extension. `assets(asset_id, name)` are the
    study's file assets; unknown names start at 1.0.0. Several files of one asset get consecutive versions in the order
    of their paths, each a further `bump`. `edam_format` overrides what the extension tells.
    """
    stem = F.regexp_replace("file_name", r"\.[^.]+$", "")
    edam = F
    for extension, uri in EDAM_FORMATS.items():
        edam = edam.when(F.lower("extension") == f".{extension}", uri)
    named = files.withColumns({"asset_name": legal_name(stem, strict=True), "edam_format": F.lit(edam_format) if edam_format else edam.otherwise(None)})
    known = named.join(
        assets.select(F.col("name").alias("asset_name"), "asset_id"), "asset_name", "left"
    )
    bumped = next_versions(
        known.where("asset_id IS NOT NULL").select("asset_id", F.lit(bump).alias("bump")).distinct(), versions
    )
    later = F.row_number().over(Window.partitionBy("asset_name").orderBy("storage_uri")) - 1
    place = ["major", "minor", "patch"].index(bump)
    first = [F.coalesce("major", F.lit(1)), F.coalesce("minor", F.lit(0)), F.coalesce("patch", F.lit(0))]
    numbers = {
        name: (first[i] + F.col("_later") if i == place else F.when(F.col("_later") > 0, 0).otherwise(first[i]) if i > place else first[i]).cast("int")
        for i, name in enumerate(["major", "minor", "patch"])
    }
    numbered = known.join(bumped, "asset_id", "left").withColumn("_later", later).withColumns(numbers)
    suffix = version_suffix(F.col("major"), F.col("minor"), F.col("patch"))
    return numbered.select(
        "asset_id", "asset_name", "storage_uri", "extension", "length", "digest", "edam_format", "major", "minor", "patch",
        F.concat(F.lit(f"files/{study}/"), "asset_name", suffix, "extension").alias("lake_path"),
    )


def verify_digests(stored: DataFrame, actual: DataFrame, key: str = "storage_uri") -> DataFrame:
    """Files that are missing on either side or whose digest differs, letter case aside: `key, status`."""
    left = stored.select(key, F.lower("digest").alias("_stored"))
    right = actual.select(key, F.lower("digest").alias("_actual"))
    status = (
        F.when(F.col("_actual").isNull(), "missing").when(F.col("_stored").isNull(), "unregistered")
        .when(F.col("_stored") != F.col("_actual"), "changed")
    )
    return left.join(right, key, "full").select(key, status.alias("status")).where("status IS NOT NULL")
