"""Ingest and transform jobs: read, transform, write one data version, record it."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake.functions.names import is_legal_name, legal_name
from studylake.functions.values import cast_integer
from studylake.operators import catalog, dictionary, eav, harmonize
from studylake.operators.ids import assign_ids
from studylake.operators.profile import declared_variables
from studylake.operators.reconcile import void_to_string
from studylake.plans.store import StudyLake
from studylake.session import local_rows, materialize
from studylake.sources import files as lake_files
from studylake.sources.readers import read_query, scan_dictionary_json, scan_eav_csv, scan_eav_transcode
from studylake.sources.writers import conform, table_schema
from studylake.types import Variable


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _user(spark: SparkSession) -> str:
    """Who runs the session."""
    return spark.range(1).select(F.current_user().alias("user")).first().user


def _one(df: DataFrame, like: DataFrame, **values: Any) -> DataFrame:
    """A one-row frame shaped like a catalog table."""
    row = tuple(values.get(name) for name in like.columns)
    return local_rows(df.sparkSession, [row], like.schema)


def upsert(lake: StudyLake, table: str, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Insert or update rows of one catalog table by its natural key, commit, and return the table.

    Rows without an id get one; link tables only take what is new. Attributes the batch does not name keep their
    values. `order` tells which of several rows with one key comes last.
    """
    existing, keys = lake.table(table), catalog.UNIQUE_KEYS[table]
    id_column = existing.columns[0]
    if id_column in keys:
        padded = incoming.select(
            *[F.col(f.name) if f.name in incoming.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in existing.schema.fields]
        )
        after = catalog.link_if_absent(existing, padded, keys)
    else:
        attributes = [name for name in existing.columns if name in incoming.columns and name not in (id_column, *keys)]
        ordered = incoming.withColumn("_order", F.lit(0) if order is None else F.col(order))
        for key in keys:
            if key not in incoming.columns:
                ordered = ordered.withColumn(key, F.lit(None).cast(existing.schema[key].dataType))
        after = catalog.upsert_by_key(existing, ordered, keys, id_column, attributes, "_order")
    lake.commit({table: after}, {table: incoming.select(*[F.col(key) if key in incoming.columns else F.lit(None).alias(key) for key in keys])})
    return lake.table(table)


def register_study(
    lake: StudyLake,
    name: str,
    study_type_id: int,
    domains: Sequence[str],
    description: str | None = None,
    external_id: str | None = None,
) -> None:
    """Create or update a study, its domains, and the links between them."""
    spark, state = lake.spark, lake.catalog()
    attributes = ["study_type_id", "description", "external_id"]
    incoming = local_rows(
        spark, [(name, study_type_id, description, external_id, 0)],
        "name string, study_type_id int, description string, external_id string, ord int",
    )
    studies = catalog.upsert_by_key(state["studies"], incoming, ["name"], "study_id", attributes, "ord")
    named = local_rows(
        spark, [(d, None, i) for i, d in enumerate(domains)], "name string, uri string, ord int"
    ).withColumn("description", F.lit(None).cast("string"))
    known = catalog.insert_if_absent(state["domains"], named, ["name", "uri"], "domain_id", ["description"], "ord")
    study_id = studies.where(F.col("name") == name).select("study_id").scalar()
    links = known.where(F.col("name").isin(list(domains))).select(study_id.alias("study_id"), "domain_id")
    lake.commit({
        "studies": studies, "domains": known,
        "study_domains": catalog.link_if_absent(state["study_domains"], links, ["study_id", "domain_id"]),
    })


def register_dictionary(lake: StudyLake, rows: DataFrame, domain_id: int, prefix: str = "") -> DataFrame:
    """Register a field dictionary; returns the report of its variables."""
    state = lake.catalog()
    new = dictionary.register(rows, domain_id, state["variables"], state["vocabularies"], prefix)
    known = state["vocabulary_items"]
    items = catalog.replace_children(known.drop("vocabulary_item_id"), new["vocabulary_items"], "vocabulary_id")
    items = catalog.number_items(items, known)
    lake.commit({"variables": new["variables"], "vocabularies": new["vocabularies"], "vocabulary_items": items})
    stored = lake.table("variables").where(F.col("domain_id") == domain_id)
    return stored.join(rows.select(F.col("field_name").alias("name")).distinct(), "name", "left_semi")


def _add_version(
    lake: StudyLake,
    study_id: int,
    name: str,
    asset_type: str,
    note: str,
    bump: str = "patch",
    explicit: tuple[int, int, int] | None = None,
) -> tuple[dict[str, DataFrame], int, int, tuple[int, int, int]]:
    """Catalog state with a new asset or asset version, before its data location is known."""
    state = lake.catalog()
    assets, versions = state["assets"], state["asset_versions"]
    asset = assets.where((F.col("study_id") == study_id) & (F.col("name") == name)).first()
    if asset is None:
        asset_id = (assets.agg(F.max("asset_id")).first()[0] or 0) + 1
        state["assets"] = assets.unionByName(
            _one(
                assets, assets, asset_id=asset_id, study_id=study_id, name=name, asset_type=asset_type, date_created=_now(),
                created_by=_user(lake.spark),
            )
        )
    elif asset.asset_type != asset_type:
        raise ValueError(f"asset {name!r} is a {asset.asset_type}")
    else:
        asset_id = asset.asset_id
    request = local_rows(lake.spark, [(asset_id, bump)], "asset_id bigint, bump string")
    row = catalog.next_versions(request, versions).first()
    number = explicit or (row.major, row.minor, row.patch)
    version_id = (versions.agg(F.max("version_id")).first()[0] or 0) + 1
    state["_version"] = _one(
        versions, versions, version_id=version_id, asset_id=asset_id, major=number[0], minor=number[1], patch=number[2],
        version_note=note, is_latest=True, created_at=_now(), created_by=_user(lake.spark),
    )
    return state, asset_id, version_id, number


def _publish(
    lake: StudyLake,
    state: dict[str, DataFrame],
    version_id: int,
    location: str,
    kind: str,
    description: str,
    provenance: Mapping[str, str] | None,
    input_version: int | None = None,
    extra: Mapping[str, DataFrame] | None = None,
) -> None:
    """Commit a written version together with its provenance."""
    spark = lake.spark
    version = state["_version"].withColumn("location", F.lit(location))
    versions = catalog.set_latest(state["asset_versions"].unionByName(version))
    table = state["transformations"]
    number = (table.agg(F.max("transformation_id")).first()[0] or 0) + 1
    done = _one(
        table, table, transformation_id=number, transformation_type=kind, description=description,
        date_created=_now(), **(provenance or {}),
    )
    edges = "transformation_id bigint, version_id bigint"
    recorded = catalog.record_provenance(
        state, done,
        local_rows(spark, [] if input_version is None else [(number, input_version)], edges),
        local_rows(spark, [(number, version_id)], edges),
    )
    lake.commit({"assets": state["assets"], "asset_versions": versions, **recorded, **(extra or {})})


def ingest_files(
    lake: StudyLake, study: str, path: str, bump: str = "patch", provenance: Mapping[str, str] | None = None,
    edam_format: str | None = None, description: str | None = None, new_version: bool = True, cell_bytes: int = lake_files.CELL_BYTES,
) -> DataFrame:
    """Register every file below `path`, empty ones too, as a new version of its asset, with digest and format.

    Files of one legal name become versions of one asset in the order of their paths. `edam_format` is the format of all files
    (otherwise the extension tells), `description` that of new assets. With `new_version=False` a file whose asset exists is
    refused. Files above `cell_bytes` are hashed as a stream; digests are the same.
    """
    spark, study_id, state = lake.spark, lake.study_id(study), lake.catalog()
    own = state["assets"].where((F.col("study_id") == study_id) & (F.col("asset_type") == "file"))
    scanned = lake_files.scan_files(spark, path, cell_bytes)
    manifest = lake_files.file_manifest(scanned, own, state["asset_versions"], study, bump, edam_format)
    # Digests are computed once: the manifest is written before the catalog tables are derived from it.
    location = f"{lake.root}/manifests/{study_id}/{_now():%Y%m%d%H%M%S%f}"
    manifest.write.parquet(location)
    manifest = spark.read.schema(manifest.schema).parquet(location)
    known = None if new_version else manifest.where("asset_id IS NOT NULL").select("asset_name").first()
    if known is not None:
        raise ValueError(f"file {known.asset_name!r} exists in study {study!r}: allow a new version")
    new = manifest.where("asset_id IS NULL").select(F.lit(study_id).alias("study_id"), F.col("asset_name").alias("name"))
    made = {"date_created": F.lit(_now()), "created_by": F.current_user()}
    new = new.withColumns({"ord": F.lit(0), "description": F.lit(description).cast("string"), "asset_type": F.lit("file"), **made})
    assets = catalog.insert_if_absent(
        state["assets"], new, ["study_id", "name"], "asset_id", ["description", "asset_type", *made], "ord"
    )
    ids = assets.where(F.col("study_id") == study_id).select(F.col("name").alias("asset_name"), F.col("asset_id").alias("id"))
    rows = manifest.join(ids, "asset_name").select(
        F.col("id").alias("asset_id"), "major", "minor", "patch", F.lit("Ingested file").alias("version_note"),
        F.lit(True).alias("is_latest"), F.lit(_now()).alias("created_at"), F.current_user().alias("created_by"),
        F.col("storage_uri").alias("location"),
        "storage_uri", "edam_format", "digest",
    )
    numbered = assign_ids(rows, ["asset_id", "storage_uri"], "version_id", state["asset_versions"])
    versions = catalog.set_latest(
        state["asset_versions"].unionByName(
            numbered.select("version_id", "asset_id", *catalog.VERSION, "version_note", "is_latest", "created_at", "created_by", "location"),
            allowMissingColumns=True,
        )
    )
    data = state["datafiles"].unionByName(
        numbered.select("version_id", "storage_uri", "edam_format", "digest", F.lit(False).alias("compressed"))
    )
    table = state["transformations"]
    transformation = (table.agg(F.max("transformation_id")).first()[0] or 0) + 1
    done = _one(
        table, table, transformation_id=transformation, transformation_type="ingest",
        description=f"Ingested files below {path} into study {study}", date_created=_now(), **(provenance or {}),
    )
    recorded = catalog.record_provenance(
        state, done, local_rows(spark, [], state["transformation_inputs"].schema),
        numbered.select(F.lit(transformation).cast("bigint").alias("transformation_id"), "version_id"),
    )
    lake.commit({"assets": assets, "asset_versions": versions, "datafiles": data, **recorded})
    return manifest


def ingest_project(
    lake: StudyLake,
    study: str,
    domain_id: int,
    dictionary_path: str,
    export_path: str,
    prefix: str = "REDCap",
    forms: Sequence[str] | None = None,
    provenance: Mapping[str, str] | None = None,
) -> DataFrame:
    """Register a survey project's dictionary and its exported EAV files; returns the files' manifest."""
    rows = scan_dictionary_json(lake.spark, dictionary_path, forms)
    register_dictionary(lake, rows, domain_id, prefix)
    return ingest_files(lake, study, export_path, provenance=provenance)


def _widened(
    rows: DataFrame, variables: Sequence[Variable], convert: bool, integer_record: bool, keys: Sequence[str], fields: Sequence[str] | None = None
) -> DataFrame:
    if convert and variables:
        return eav.wide_typed(rows, variables, integer_record, keys=keys)
    return eav.wide_raw(rows, fields, keys)


def _renewed(
    lake: StudyLake, rows: DataFrame, digests: DataFrame, keys: Sequence[str], made_by: str, asset_id: int, versions: DataFrame,
    widen: Callable[[DataFrame], DataFrame],
) -> DataFrame | None:
    """The wide table of `rows` from the asset's latest version: its rows for records that haven't changed, new ones for the others.

    None if there is no earlier version that was made in the same way, so that nothing can be taken from it.
    """
    latest = catalog.latest_versions(versions.where(F.col("asset_id") == asset_id)).first()
    before = None if latest is None else lake.record_digests(latest.location, made_by, digests.schema)
    if before is None:
        return None
    # Digests are of records as the table has them, NULL parts of a key never count as known.
    same = materialize(digests.join(before, digests.columns).select(*keys), "same-records")
    known = lake.spark.read.parquet(latest.location)
    changed = rows.join(same, list(keys), "left_anti")
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in known.columns]
    return known.join(same, list(keys), "left_semi").select(*columns).union(widen(changed).select(*columns))


def eav_to_dataset(
    lake: StudyLake,
    study: str,
    file_asset: str,
    path: str | None = None,
    convert: bool = True,
    rows: DataFrame | None = None,
    integer_record: bool = True,
    charset: str | None = None,
    provenance: Mapping[str, str] | None = None,
    multi_line: bool = False,
    keys: Sequence[str] = eav.RECORD,
    incremental: bool = False,
) -> DataFrame:
    """Turn an EAV file into a typed, versioned dataset named after the file without `_eav`.

    The rows come from `rows`, from `path`, or from the latest version of the file asset; `charset` names the
    file's single-byte character set if it is not UTF-8. Files are split between tasks; set `multi_line` for exports
    whose values hold line breaks, which makes a file one task. Fields without a variable are left out; all of them
    are named in a warning and stored beside the dataset (`StudyLake.fields_left_out`). Longitudinal exports name the columns that
    make a row with the record in `keys`; otherwise such columns are ignored.

    A digest of each record is stored beside the dataset. With `incremental`, records whose digests are those of the latest version
    are copied from it and only the others are widened; the result is that of a full rebuild. The latest version must have been made
    with the same variables, keys and options; otherwise everything is widened.
    """
    study_id, state = lake.study_id(study), lake.catalog()
    source = state["assets"].where((F.col("study_id") == study_id) & (F.col("name") == file_asset)).first()
    input_version = None
    if source is not None:
        latest = catalog.latest_versions(state["asset_versions"].where(F.col("asset_id") == source.asset_id)).first()
        input_version, path = latest.version_id, path or latest.location
    if rows is None:
        if path is None:
            raise ValueError(f"no file {file_asset!r} in study {study!r}")
        # Text is parsed once; later steps read columns.
        if charset:
            export = scan_eav_transcode(lake.spark, path, charset, multi_line, keys)
        else:
            export = scan_eav_csv(lake.spark, path, multi_line, keys=keys)
        rows = materialize(export, "eav")
    stem = file_asset.removesuffix("_eav")
    name = lake.spark.range(1).select(legal_name(F.lit(stem), strict=True).alias("n")).first().n

    known = catalog.study_variables(state["variables"], state["study_domains"], study_id)
    fields = materialize(rows.select("field_name").distinct(), "fields")
    unmatched = materialize(eav.unmatched_fields(fields, known), "unmatched")
    left_out = [row.field_name for row in unmatched.orderBy("field_name").collect()]
    if left_out:
        warnings.warn(f"fields without a variable: {left_out}", stacklevel=2)
    matched = eav.variable_match(fields, known)
    variables = eav.variable_list(matched)
    typed = convert and bool(variables)
    columns = None if typed else eav.column_names(fields)

    def widen(some: DataFrame) -> DataFrame:
        return _widened(some, variables, convert, integer_record, keys, columns)

    # A version can be built on if it was made of the same columns in the same way.
    recipe = [typed, integer_record, list(keys), [tuple(v) for v in variables] if typed else columns]
    made_by = hashlib.sha256(json.dumps(recipe).encode()).hexdigest()
    as_stored = {"record": cast_integer(F.col("record"))} if typed and integer_record and "record" in keys else {}
    rows = rows.withColumn("_record", F.col("record")).withColumns(as_stored)
    digests = materialize(eav.record_digests(rows, keys), "digests")
    asset = state["assets"].where((F.col("study_id") == study_id) & (F.col("name") == name)).first()
    wide = None
    if incremental and asset is not None:
        again = lambda some: widen(some.withColumn("record", F.col("_record")).drop("_record"))
        wide = _renewed(lake, rows, digests, keys, made_by, asset.asset_id, state["asset_versions"], again)
    if wide is None:
        wide = widen(rows.withColumn("record", F.col("_record")).drop("_record"))
    state, _, version_id, number = _add_version(lake, study_id, name, "dataset", f"Dataset from eav file {file_asset}")
    location = lake.new_data_path(study, name, number)
    wide.write.parquet(location)
    unmatched.write.parquet(lake.left_out_path(location))
    digests.write.parquet(lake.digests_path(location, made_by))
    links = matched.select(
        F.lit(version_id).cast("bigint").alias("version_id"), "variable_id", F.lit(None).cast("int").alias("ordinal"), "keyrole"
    )
    links = catalog.link_if_absent(state["dataset_variables"], links, ["version_id", "variable_id"])
    _publish(
        lake, state, version_id, location, "transform", f"Transformed eav {file_asset} to dataset {name}",
        provenance, input_version, {"dataset_variables": links},
    )
    return lake.spark.read.parquet(location)


def describe_datasets(lake: StudyLake, study: str, include_versions: bool = False) -> DataFrame:
    """The study's datasets with their latest version, or all of them, its variables and those variables' vocabulary items."""
    study_id, state = lake.study_id(study), lake.catalog()
    own = state["assets"].where(F.col("study_id") == study_id)
    nested = catalog.vocabulary_items_nested(state["vocabularies"], state["vocabulary_items"])
    return catalog.datasets_described(own, state["asset_versions"], state["dataset_variables"], state["variables"], nested, include_versions)


def query_to_dataset(
    lake: StudyLake,
    study: str,
    domain_id: int,
    name: str,
    sql: str,
    replace: bool = False,
    new_version: tuple[int, int, int] | None = None,
    jdbc: Mapping[str, str] | None = None,
    partition: tuple[str, Any, Any, int] | None = None,
    variables: DataFrame | None = None,
    provenance: Mapping[str, str] | None = None,
) -> DataFrame:
    """Store the result of a query as a dataset version.

    Column types come from the analysed query; `variables` (a `profile_catalog` result for the source) refines
    them and brings vocabularies; text categories are stored as their integer value beside the text. Known variables of the domain are reused, never overwritten.
    """
    spark, study_id = lake.spark, lake.study_id(study)
    legal = spark.range(1).select(is_legal_name(F.lit(name), strict=True).alias("ok")).first().ok
    if not legal:
        raise ValueError(f"not a legal dataset name: {name!r}")
    existing = lake.table("assets").where(
        (F.col("study_id") == study_id) & (F.col("name") == name) & (F.col("asset_type") == "dataset")
    ).first()
    if existing is not None and not replace:
        raise ValueError(f"dataset {name!r} exists in study {study!r}: pass replace=True for a new version")

    result = void_to_string(read_query(spark, sql, jdbc, partition))
    declared = local_rows(
        spark, [(n, k, c, i) for i, (n, k, c) in enumerate(declared_variables(result))],
        "name string, value_type_id int, description string, ord int",
    ).withColumn("domain_id", F.lit(domain_id).cast("bigint"))
    state, _, version_id, number = _add_version(lake, study_id, name, "dataset", f"Query dataset {name}", explicit=new_version)
    vocabularies, items = state["vocabularies"], state["vocabulary_items"]
    if variables is not None:
        variables = materialize(variables.where(F.col("column_name").isin(result.columns)), "variables")
        names = [row.column_name for row in variables.select("column_name").collect()]
        if len(set(names)) < len(names):
            raise ValueError("variables describe a column more than once: choose those of one source table")
        for row in variables.where(F.col("items").isNotNull()).collect():
            if isinstance(result.schema[row.column_name].dataType, T.StringType):
                items_of = local_rows(spark, [tuple(item) for item in row["items"]], "value bigint, code string, description string")
                result = category_values(result, row.column_name, items_of)
        refined = variables.select(
            F.col("column_name").alias("name"), F.col("value_type_id").alias("kind"), F.col("description").alias("comment"),
            "vocabulary_name", "vocabulary_description", "items",
        )
        declared = declared.join(refined, "name", "left").withColumns({
            "value_type_id": F.coalesce("kind", "value_type_id"), "description": F.coalesce("comment", "description"),
        })
        coded = declared.where("vocabulary_name IS NOT NULL").select(
            "domain_id", F.col("vocabulary_name").alias("name"), F.col("vocabulary_description").alias("description"), "items", "ord",
        )
        fresh = coded.join(vocabularies, ["domain_id", "name"], "left_anti")
        vocabularies = catalog.insert_if_absent(vocabularies, coded, ["domain_id", "name"], "vocabulary_id", ["description"], "ord")
        loaded = fresh.join(vocabularies.select("vocabulary_id", "domain_id", "name"), ["domain_id", "name"]).select(
            "vocabulary_id", F.inline("items")
        )
        items = catalog.number_items(items.drop("vocabulary_item_id").unionByName(loaded), items)
        declared = declared.join(
            vocabularies.where(F.col("domain_id") == domain_id)
            .select("vocabulary_id", F.col("name").alias("vocabulary_name")), "vocabulary_name", "left",
        )
    else:
        declared = declared.withColumn("vocabulary_id", F.lit(None).cast("bigint"))
    declared = declared.withColumn("keyrole", F.lit("none"))
    registered = catalog.insert_if_absent(
        state["variables"], declared, ["domain_id", "name"], "variable_id",
        ["value_type_id", "vocabulary_id", "description", "keyrole"], "ord",
    )
    location = lake.new_data_path(study, name, number)
    result.write.parquet(location)
    links = declared.select("name", F.col("ord").alias("ordinal"), "keyrole").join(
        registered.where(F.col("domain_id") == domain_id).select("variable_id", "name"), "name"
    ).withColumn("version_id", F.lit(version_id).cast("bigint"))
    links = catalog.link_if_absent(state["dataset_variables"], links, ["version_id", "variable_id"])
    _publish(
        lake, state, version_id, location, "ingest", f"Ingested sql\n{sql}\nto dataset {name}", provenance,
        extra={
            "variables": registered, "vocabularies": vocabularies, "vocabulary_items": items, "dataset_variables": links,
        },
    )
    return spark.read.parquet(location)


def load_query(lake: StudyLake, sql: str, variables: Sequence[Variable], location: str, **source: Any) -> DataFrame:
    """Run a SELECT and store it with the variables' columns, in their order and types."""
    result = read_query(lake.spark, sql, **source)
    conform(result, table_schema(variables)).write.parquet(location)
    return lake.spark.read.parquet(location)

def category_values(df: DataFrame, column: str, items: DataFrame) -> DataFrame:
    """Text category -> its integer value, with the text kept as `<column>_raw` beside it."""
    lookup = items.groupBy(F.col("code").alias("_code")).agg(F.min("value").cast("int").alias("_value"))
    coded = df.join(lookup, df[column] == lookup["_code"], "left")
    columns = []
    for name in df.columns:
        columns += [F.col("_value").alias(name), df[name].alias(f"{name}_raw")] if name == column else [df[name]]
    return coded.select(*columns)


# --- harmonisation tables -------------------------------------------------------------------------------------

def record_instances(
    lake: StudyLake, rows: DataFrame, entity_id: int, study_id: str, external_id: str, transformation_id: int
) -> DataFrame:
    """Store the external ids of `rows` that the lake does not know yet as instances of an entity; returns all instances."""
    known = lake.table("entity_instances")
    fresh = harmonize.extract_entity_instances(rows, entity_id, study_id, external_id, transformation_id, known)
    lake.commit({"entity_instances": known.unionByName(fresh.select(*known.columns))})
    return lake.table("entity_instances")


def record_relations(
    lake: StudyLake, rows: DataFrame, relation_id: int, subject: str, object_: str, at: str, transformation_id: int,
    study_id: str = "study_id",
) -> DataFrame:
    """Store the relations of `rows` between stored instances of the relation's two entities; returns all relations.

    A pair the lake knows keeps its id, and its period grows to hold the new dates.
    """
    state = lake.catalog()
    relation = state["entity_relations"].where(F.col("entity_relation_id") == relation_id).first()
    if relation is None:
        raise ValueError(f"unknown relation {relation_id}")
    instances, known = state["entity_instances"], state["relation_instances"]
    subjects = instances.where(F.col("entity_id") == relation.subject_entity_id)
    objects = instances.where(F.col("entity_id") == relation.object_entity_id)
    found = harmonize.extract_relation_instances(rows, subject, object_, at, subjects, objects, relation_id, transformation_id, study_id)
    keys = catalog.UNIQUE_KEYS["relation_instances"]
    dates = found.select(*keys, F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"))
    grown = known.join(dates, keys, "left").withColumns(
        {"valid_from": F.least("valid_from", "_from"), "valid_to": F.greatest("valid_to", "_to")}
    )
    fresh = assign_ids(found.join(known.select(*keys), keys, "left_anti"), keys, "relation_instance_id", known)
    fresh = fresh.withColumn("external_id", F.lit(None).cast("string"))
    lake.commit({"relation_instances": grown.select(*known.columns).unionByName(fresh.select(*known.columns))})
    return lake.table("relation_instances")


def record_asset_entities(
    lake: StudyLake, rows: DataFrame, asset_id: str, external_id: str, entity_id: int, study_id: str = "study_id"
) -> DataFrame:
    """Store which stored instances of an entity occur in which asset; returns all links."""
    state = lake.catalog()
    instances = state["entity_instances"].where(F.col("entity_id") == entity_id)
    links = harmonize.asset_entities(rows, asset_id, external_id, instances, study_id)
    known = state["data_asset_entities"]
    lake.commit({"data_asset_entities": catalog.link_if_absent(known, links, known.columns)})
    return lake.table("data_asset_entities")


def record_vocabulary_mapping(lake: StudyLake, pairs: DataFrame) -> DataFrame:
    """Store that items mean the same, `pairs(from_vocabulary_item, to_vocabulary_item)`; returns the whole mapping."""
    return upsert(lake, "vocabulary_mapping", pairs.select("from_vocabulary_item", "to_vocabulary_item").distinct())


def stored_classes(lake: StudyLake) -> DataFrame:
    """The classes of the lake's vocabulary items, ready for `harmonize.recode_between` and `harmonize.class_conflicts`."""
    return harmonize.item_classes(lake.table("vocabulary_items"), lake.table("vocabulary_mapping"))


def recode(lake: StudyLake, df: DataFrame, column: str, from_vocabulary: str, to_vocabulary: str, out: str, domain_id: int | None = None) -> DataFrame:
    """Translate a category column between two vocabularies of the lake, named (in one domain, if names recur)."""
    known = lake.table("vocabularies")
    if domain_id is not None:
        known = known.where(F.col("domain_id") == domain_id)
    ids = []
    for name in (from_vocabulary, to_vocabulary):
        rows = known.where(F.col("name") == name).select("vocabulary_id").limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"{'no' if not rows else 'several'} vocabularies {name!r}")
        ids.append(rows[0].vocabulary_id)
    return harmonize.recode_between(df, column, stored_classes(lake), *ids, out)


def stored_rules(lake: StudyLake) -> list[harmonize.MappingRule]:
    """The lake's variable mapping, ready for `harmonize.apply_variable_mapping`; `upsert` stores rows of it."""
    return harmonize.mapping_rules(lake.table("variable_mapping"), lake.table("variables"))
