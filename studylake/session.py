"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Partitions of `spread` at least.
MIN_PARTITIONS = 32


def build_session(cores: str = "*", app: str = "studylake", **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="studylake-")
    return _LOCAL_ROOTS[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet below the shared scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Write `df` to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` by these keys in as many partitions as the session gives a shuffle, for work that holds a partition's groups in memory.

    Adaptive execution merges shuffle partitions by their compressed bytes until there is one a core; groups of small keys take many
    times as much memory. A number of partitions that is asked for stays.
    """
    return df.repartition(max(MIN_PARTITIONS, partitions(df.sparkSession)), *keys)


def local_rows(spark: SparkSession, rows, schema: str | T.StructType) -> DataFrame:
    """A few rows, or none, as a frame whose size Spark knows when it plans."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    table = pa.Table.from_pylist([dict(zip(fields.names, row)) for row in rows], schema=to_arrow_schema(fields))
    return spark.createDataFrame(table, fields)
