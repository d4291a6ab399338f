"""A study lake below one root folder: immutable data versions and catalog tables as Parquet.

A commit writes its data and the catalog tables it changes to paths nobody reads yet, and becomes visible by one
last append to the `commits` table, which names the current path of each changed table. A job that dies earlier
leaves files no reader looks at. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake.functions.names import dataset_name
from studylake.operators import catalog
from studylake.session import local_rows
from studylake.types import CATALOG_SCHEMAS

COMMITS_SCHEMA = "commit_no BIGINT, table_name STRING, location STRING"
#: Who added a row, and when: NULL for rows that come without them.
AUDIT_COLUMNS = ("date_created", "created_by")


class StudyLake:
    """Catalog tables and dataset versions of one lake."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS_SCHEMA).parquet(f"{self.root}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return local_rows(self.spark, [], COMMITS_SCHEMA)

    def locations(self) -> dict[str, str]:
        """Current path of each catalog table; there are as many as the data model has tables."""
        newest = self.commits().groupBy("table_name").agg(F.max_by("location", "commit_no").alias("location"))
        return {row.table_name: row.location for row in newest.collect()}

    def table(self, name: str, locations: Mapping[str, str] | None = None) -> DataFrame:
        schema = CATALOG_SCHEMAS[name]
        location = (self.locations() if locations is None else locations).get(name)
        if location is None:
            return local_rows(self.spark, [], schema)
        return self.spark.read.schema(schema).parquet(location)

    def catalog(self) -> dict[str, DataFrame]:
        locations = self.locations()
        return {name: self.table(name, locations) for name in CATALOG_SCHEMAS}

    def commit(self, changes: Mapping[str, DataFrame], keys: Mapping[str, DataFrame] | None = None) -> None:
        """Write changed catalog tables, check the resulting state, then publish it in one append.

        `keys` are the natural keys of the rows that a change adds, alters or removes, where the caller knows them; of a table that is
        not named there all rows are checked. Rows need all columns of their table but `AUDIT_COLUMNS`.
        """
        locations = self.locations()
        state = {name: self.table(name, locations) for name in locations}
        old = dict(state)
        before = state.get("asset_versions")
        attempt = uuid.uuid4().hex
        written = {}
        for name, df in changes.items():
            location = f"{self.root}/catalog/{name}/{attempt}"
            schema = T.StructType.fromDDL(CATALOG_SCHEMAS[name])
            given = {c.lower() for c in df.columns}
            unknown = [f.name for f in schema.fields if f.name in AUDIT_COLUMNS and f.name not in given]
            df = df.withColumns({c: F.lit(None) for c in unknown}) if unknown else df
            df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.parquet(location)
            written[name] = location
            state[name] = self.spark.read.schema(schema).parquet(location)
        touched = None
        if keys:
            of = lambda name: catalog.UNIQUE_KEYS[name]
            touched = {
                name: reduce(DataFrame.unionByName, [catalog.with_keys(side[name], named, of(name)) for side in (old, state) if name in side])
                for name, named in keys.items()
            }
        refused = catalog.constraint_violations(state, before, list(changes), touched).first()
        if refused is not None:
            raise ValueError(f"refused commit: {refused.violation} ({refused.key}, {refused.n} rows)")
        number = (self.commits().agg(F.max("commit_no")).first()[0] or 0) + 1
        rows = [(number, name, location) for name, location in written.items()]
        published = local_rows(self.spark, rows, COMMITS_SCHEMA).coalesce(1)
        published.write.mode("append").parquet(f"{self.root}/commits")

    def study_id(self, study: str) -> int:
        row = self.table("studies").where(F.col("name") == study).select("study_id").first()
        if row is None:
            raise ValueError(f"unknown study {study!r}")
        return row.study_id

    def new_data_path(self, study: str, asset: str, version: tuple[int, int, int]) -> str:
        """Fresh path for one version of a dataset, named after study, dataset and version."""
        name = self.spark.range(1).select(
            dataset_name(F.lit(study), F.lit(asset), *[F.lit(n) for n in version]).alias("name")
        ).first().name
        return f"{self.root}/data/{name.replace('.', '/', 1)}/{uuid.uuid4().hex}"

    @staticmethod
    def left_out_path(location: str) -> str:
        """Where the fields a dataset version left out are listed."""
        return f"{location}-left-out"

    @staticmethod
    def digests_path(location: str, made_by: str) -> str:
        """Where the digests of a dataset version's records are, by the way it was made."""
        return f"{location}-digests/{made_by}"

    def record_digests(self, location: str, made_by: str, schema: T.StructType) -> DataFrame | None:
        """Digests of the records of the version at `location`, None if it was made in another way."""
        try:
            return self.spark.read.schema(schema).parquet(self.digests_path(location, made_by))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def fields_left_out(self, location: str) -> DataFrame:
        """`field_name` of every field the dataset version at `location` has no variable for."""
        return self.spark.read.schema("field_name STRING").parquet(self.left_out_path(location))

    def read_dataset(self, study: str, dataset: str, version: tuple[int, int, int] | None = None) -> DataFrame:
        """A dataset's latest version, or the one asked for."""
        study_id = self.study_id(study)
        locations = self.locations()
        asset = self.table("assets", locations).where(
            (F.col("study_id") == study_id) & (F.col("name") == dataset) & (F.col("asset_type") == "dataset")
        ).first()
        if asset is None:
            raise ValueError(f"no dataset {dataset!r} in study {study!r}")
        versions = self.table("asset_versions", locations).where(F.col("asset_id") == asset.asset_id)
        if version is None:
            row = catalog.latest_versions(versions).first()
        else:
            row = versions.where(
                (F.col("major") == version[0]) & (F.col("minor") == version[1]) & (F.col("patch") == version[2])
            ).first()
        if row is None:
            raise ValueError(f"no version {version} of dataset {dataset!r} in study {study!r}")
        return self.spark.read.parquet(row.location)
