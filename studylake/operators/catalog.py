"""Set-based catalog operators: whole batches of studies, variables, versions and provenance at a time.

State changes take the `existing` table and an `incoming` batch and return the new table. "One row per group"
is asked as `max_by` over the group, never as a window: it combines on the map side, so an asset or key that
holds a third of all rows still reaches the reducer as a handful of partial results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake import types as VT
from studylake.functions.names import dataset_name
from studylake.operators.ids import assign_ids, key_text, same_key
from studylake.session import local_rows, materialize

VERSION = ["major", "minor", "patch"]


# --- changing state -------------------------------------------------------------------------------------------

def last_per_key(incoming: DataFrame, keys: Sequence[str], attributes: Sequence[str], order: str) -> DataFrame:
    """One row per natural key, the one that came last."""
    last = F.max_by(F.struct(*attributes), F.struct(order, *attributes)).alias("_last")
    return incoming.groupBy(*keys).agg(last).select(*keys, "_last.*")


def upsert_by_key(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    id_column: str,
    attributes: Sequence[str],
    order: str,
) -> DataFrame:
    """Insert new natural keys with new ids; overwrite the attributes of known keys and keep their ids.

    Within the batch the row with the highest `order` wins. NULL attributes overwrite too.
    """
    batch = last_per_key(incoming, keys, attributes, order)
    kept = existing.alias("e").join(
        batch.withColumn("_hit", F.lit(True)).alias("i"), same_key("e", "i", keys), "left"
    )
    columns = []
    for name in existing.columns:
        old = F.col(f"e.{name}")
        columns.append(
            F.when(F.col("i._hit"), F.col(f"i.{name}").cast(existing.schema[name].dataType)).otherwise(old).alias(name)
            if name in attributes else old
        )
    return kept.select(*columns).unionByName(_new_rows(existing, batch, keys, id_column, attributes))


def _new_rows(
    existing: DataFrame, batch: DataFrame, keys: Sequence[str], id_column: str, attributes: Sequence[str]
) -> DataFrame:
    unknown = batch.alias("i").join(existing.alias("e"), same_key("i", "e", keys), "left_anti")
    numbered = assign_ids(unknown, keys, id_column, existing)
    given = {id_column, *keys, *attributes}
    return numbered.select(
        *[
            (F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in existing.schema.fields
        ]
    )


def insert_if_absent(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    id_column: str,
    attributes: Sequence[str],
    order: str,
) -> DataFrame:
    """Add unknown keys only; known rows are never overwritten."""
    batch = last_per_key(incoming, keys, attributes, order)
    return existing.unionByName(_new_rows(existing, batch, keys, id_column, attributes))


def replace_children(existing: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Drop all rows of the parents that the batch mentions and load the batch instead.

    A parent row whose other columns are all NULL empties the parent.
    """
    others = [name for name in existing.columns if name != parent]
    filled = reduce(lambda a, b: a | b, [F.col(name).isNotNull() for name in others])
    reloaded = incoming.select(parent).distinct()
    return existing.join(reloaded, parent, "left_anti").select(*existing.columns).unionByName(
        incoming.where(filled).select(*existing.columns)
    )


def with_keys(rows: DataFrame, named: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose natural key is among those of `named`."""
    wanted = named.select(*keys).distinct()
    return rows.alias("r").join(wanted.alias("k"), same_key("r", "k", keys), "left_semi")


def number_items(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Vocabulary items with their ids in `existing`, and new ids for those it does not hold (or holds without an id).

    An item is known by vocabulary, value and code; several alike are told apart by their order.
    """
    keys = ["vocabulary_id", "value", "code"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("description")).alias("_nth")
    known = existing.where("vocabulary_item_id IS NOT NULL").select(*keys, nth, "vocabulary_item_id")
    wanted = items.select(*keys, "description", nth)
    joined = wanted.alias("i").join(known.alias("e"), same_key("i", "e", [*keys, "_nth"]), "left").select("i.*", "e.vocabulary_item_id")
    fresh = joined.where("vocabulary_item_id IS NULL").drop("vocabulary_item_id")
    numbered = assign_ids(fresh, [*keys, "_nth"], "vocabulary_item_id", existing)
    return joined.where("vocabulary_item_id IS NOT NULL").unionByName(numbered).select("vocabulary_item_id", *keys, "description")


def link_if_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add link rows, ignoring those already there or given twice."""
    fresh = incoming.dropDuplicates(list(keys)).alias("i")
    unknown = fresh.join(existing.alias("e"), same_key("i", "e", keys), "left_anti")
    return existing.unionByName(unknown.select(*existing.columns))


def update_by_key(existing: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Set `columns` of the rows a change matches; NULL can be written. Unmatched changes do nothing."""
    hit = changes.select(*keys, *columns, F.lit(True).alias("_hit")).alias("c")
    joined = existing.alias("e").join(hit, same_key("e", "c", keys), "left")
    return joined.select(
        *[
            F.when(F.col("c._hit"), F.col(f"c.{name}")).otherwise(F.col(f"e.{name}")).alias(name)
            if name in columns else F.col(f"e.{name}")
            for name in existing.columns
        ]
    )


# --- looking up -----------------------------------------------------------------------------------------------

def lookup_by_key(table: DataFrame, wanted: DataFrame, keys: Sequence[str], found: str = "found") -> DataFrame:
    """Each wanted key with its row, or NULLs and `found = false`."""
    distinct = wanted.select(*keys).distinct().alias("w")
    joined = distinct.join(table.withColumn("_hit", F.lit(True)).alias("t"), same_key("w", "t", keys), "left")
    others = [name for name in table.columns if name not in keys]
    return joined.select(
        *[F.col(f"w.{k}") for k in keys],
        *[F.col(f"t.{name}") for name in others],
        F.coalesce(F.col("t._hit"), F.lit(False)).alias(found),
    )


def lookup_unique_name(vocabularies: DataFrame, id_column: str = "vocabulary_id") -> DataFrame:
    """Id per name, NULL and `ambiguous` where several domains use the name."""
    per_name = vocabularies.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_domains"), F.min(id_column).alias("_id")
    )
    single = F.col("n_domains") == 1
    return per_name.select(
        "name", "n_domains", F.when(single, F.col("_id")).alias(id_column), (~single).alias("ambiguous")
    )


def unique_id(vocabularies: DataFrame, name: str, id_column: str = "vocabulary_id"):
    """Id of one name, None if absent, an error if several domains use it."""
    row = lookup_unique_name(vocabularies.where(F.col("name") == name), id_column).first()
    if row is None:
        return None
    if row.ambiguous:
        raise ValueError(f"{name!r} is used in {row.n_domains} domains: name the domain")
    return row[id_column]


def list_ordered(table: DataFrame, *columns: str, where: Column | None = None, by: str = "name") -> DataFrame:
    """Listing ordered by name."""
    rows = table if where is None else table.where(where)
    return (rows.select(*columns) if columns else rows).orderBy(by)


# --- versions -------------------------------------------------------------------------------------------------

def latest_versions(versions: DataFrame) -> DataFrame:
    """Latest version per asset: the flagged one, else the highest number."""
    rank = F.struct(F.coalesce("is_latest", F.lit(False)).alias("flag"), *VERSION, "version_id")
    others = [name for name in versions.columns if name != "asset_id"]
    latest = versions.groupBy("asset_id").agg(F.max_by(F.struct(*others), rank).alias("_v"))
    return latest.select("asset_id", "_v.*").select(*versions.columns)


def next_versions(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Next number per requested asset: `requests(asset_id, bump)` with bump major, minor or patch (default).

    Assets without a version start at 1.0.0.
    """
    latest = latest_versions(versions).select("asset_id", *VERSION)
    bump = F.coalesce(F.col("bump"), F.lit("patch"))
    new = F.col("major").isNull()
    return requests.join(latest, "asset_id", "left").select(
        "asset_id",
        F.when(new, 1).when(bump == "major", F.col("major") + 1).otherwise(F.col("major")).cast("int").alias("major"),
        F.when(new | (bump == "major"), 0).when(bump == "minor", F.col("minor") + 1)
        .otherwise(F.col("minor")).cast("int").alias("minor"),
        F.when(new | bump.isin("major", "minor"), 0).otherwise(F.col("patch") + 1).cast("int").alias("patch"),
    )


def set_latest(versions: DataFrame) -> DataFrame:
    """Flag exactly one version per asset: the newest insert, by time and then by number.

    The winners are joined back on the version id, which is unique, so a hot asset does not skew the join.
    """
    rank = F.struct("created_at", *VERSION, "version_id")
    winners = versions.groupBy("asset_id").agg(F.max_by("version_id", rank).alias("version_id"))
    flagged = winners.select("version_id", F.lit(True).alias("_won"))
    return versions.drop("is_latest").join(flagged, "version_id", "left").select(
        *[
            F.coalesce("_won", F.lit(False)).alias("is_latest") if name == "is_latest" else F.col(name)
            for name in versions.columns
        ]
    )


def version_label() -> Column:
    return F.concat(F.lit("v"), F.concat_ws(".", *[F.col(name).cast("string") for name in VERSION]))


def version_history(versions: DataFrame, asset_ids: DataFrame | None = None) -> DataFrame:
    """All versions per asset in numeric order, with a label such as `v1.10.0`."""
    if asset_ids is not None:
        versions = versions.join(asset_ids.select("asset_id").distinct(), "asset_id", "left_semi")
    return versions.withColumn("version_label", version_label()).orderBy("asset_id", *VERSION)


def dataset_names(studies: DataFrame, assets: DataFrame, versions: DataFrame) -> DataFrame:
    """Table name of every dataset version."""
    named = assets.where(F.col("asset_type") == "dataset").alias("a").join(
        studies.alias("s"), F.col("a.study_id") == F.col("s.study_id")
    ).select("a.asset_id", F.col("a.name").alias("asset"), F.col("s.name").alias("study"))
    return versions.join(named, "asset_id").select(
        "version_id",
        dataset_name(F.col("study"), F.col("asset"), *[F.col(name) for name in VERSION]).alias("table_name"),
    )


# --- constraints ----------------------------------------------------------------------------------------------

# Natural keys, and references: table, column, parent table, parent column.
UNIQUE_KEYS = {
    "studies": ["name"], "domains": ["name", "uri"], "study_domains": ["study_id", "domain_id"],
    "study_access": ["study_id", "user_id"], "variables": ["domain_id", "name"],
    "vocabularies": ["domain_id", "name"], "vocabulary_items": ["vocabulary_item_id"],
    "vocabulary_mapping": ["from_vocabulary_item", "to_vocabulary_item"], "assets": ["study_id", "name"],
    "asset_versions": ["asset_id", *VERSION], "dataset_variables": ["version_id", "variable_id"],
    "transformation_inputs": ["transformation_id", "version_id"],
    "transformation_outputs": ["transformation_id", "version_id"],
    "entities": ["domain_id", "name"], "entity_relations": ["domain_id", "name"],
    "entity_instances": ["entity_id", "study_id", "external_id"],
    "relation_instances": ["entity_relation_id", "entity_instance_id_1", "entity_instance_id_2"],
    "data_asset_entities": ["asset_id", "entity_instance_id"],
    "variable_mapping": ["from_variable_id", "to_variable_id", "operator", "operants"],
}
REFERENCES = [
    ("study_domains", "study_id", "studies", "study_id"), ("study_domains", "domain_id", "domains", "domain_id"),
    ("study_access", "study_id", "studies", "study_id"),
    ("variables", "domain_id", "domains", "domain_id"), ("variables", "vocabulary_id", "vocabularies", "vocabulary_id"),
    ("vocabularies", "domain_id", "domains", "domain_id"),
    ("vocabulary_items", "vocabulary_id", "vocabularies", "vocabulary_id"),
    ("vocabulary_mapping", "from_vocabulary_item", "vocabulary_items", "vocabulary_item_id"),
    ("vocabulary_mapping", "to_vocabulary_item", "vocabulary_items", "vocabulary_item_id"),
    ("assets", "study_id", "studies", "study_id"), ("asset_versions", "asset_id", "assets", "asset_id"),
    ("datafiles", "version_id", "asset_versions", "version_id"),
    ("dataset_variables", "version_id", "asset_versions", "version_id"),
    ("dataset_variables", "variable_id", "variables", "variable_id"),
    ("transformation_inputs", "transformation_id", "transformations", "transformation_id"),
    ("transformation_inputs", "version_id", "asset_versions", "version_id"),
    ("transformation_outputs", "transformation_id", "transformations", "transformation_id"),
    ("transformation_outputs", "version_id", "asset_versions", "version_id"),
    ("entities", "domain_id", "domains", "domain_id"),
    ("entity_relations", "subject_entity_id", "entities", "entity_id"),
    ("entity_relations", "object_entity_id", "entities", "entity_id"),
    ("entity_instances", "entity_id", "entities", "entity_id"), ("entity_instances", "study_id", "studies", "study_id"),
    ("entity_instances", "transformation_id", "transformations", "transformation_id"),
    ("relation_instances", "entity_relation_id", "entity_relations", "entity_relation_id"),
    ("relation_instances", "entity_instance_id_1", "entity_instances", "instance_id"),
    ("relation_instances", "entity_instance_id_2", "entity_instances", "instance_id"),
    ("relation_instances", "transformation_id", "transformations", "transformation_id"),
    ("data_asset_entities", "asset_id", "assets", "asset_id"),
    ("data_asset_entities", "entity_instance_id", "entity_instances", "instance_id"),
    ("variable_mapping", "from_variable_id", "variables", "variable_id"),
    ("variable_mapping", "to_variable_id", "variables", "variable_id"),
    ("variable_mapping", "prerequisite_id", "variables", "variable_id"),
]
# What a column may hold: listed values, or the ids of seeded rows. NULL is left to the column.
ALLOWED = [
    ("variables", "keyrole", VT.KEY_ROLES), ("dataset_variables", "keyrole", VT.KEY_ROLES), ("assets", "asset_type", VT.ASSET_TYPES),
    ("transformations", "transformation_type", VT.TRANSFORMATION_TYPES), ("variable_mapping", "operator", VT.MAPPING_OPERATORS),
    ("variables", "value_type_id", tuple(row[0] for row in VT.VALUE_TYPES)), ("studies", "study_type_id", tuple(row[0] for row in VT.STUDY_TYPES)),
]


class _Check(NamedTuple):
    """What one row of a table says to a check: it uses a key, or makes it known."""

    violation: str
    keys: Sequence[str]
    known: bool = False
    where: Column | None = None

    def row(self) -> Column:
        said = F.struct(
            F.lit(self.violation).alias("violation"), key_text(self.keys).alias("key"), _key_label(self.keys).alias("label"),
            F.lit(int(not self.known)).alias("_used"), F.lit(int(self.known)).alias("_known"),
        )
        return said if self.where is None else F.when(self.where, said)


def _key_label(keys: Sequence[str]) -> Column:
    """A key as it is reported; keys are told apart by `ids.key_text`."""
    return F.concat_ws("|", *[F.coalesce(F.col(key).cast("string"), F.lit("NULL")) for key in keys])


def renumbered(before: DataFrame, after: DataFrame) -> DataFrame:
    """Versions whose number changed; numbers are fixed once a version exists."""
    old = before.select("version_id", F.struct(*VERSION).alias("_old"))
    changed = after.join(old, "version_id").where(~F.struct(*VERSION).eqNullSafe(F.col("_old")))
    return changed.select(
        F.lit("version number changed").alias("violation"), _key_label(["version_id"]).alias("key"), F.lit(1).cast("bigint").alias("n")
    )


def _checks(tables: Mapping[str, DataFrame], changed: Sequence[str] | None) -> dict[str, list[_Check]]:
    """The checks that rows of each table take part in; with `changed` only those that a changed table takes part in."""
    def due(*names: str) -> bool:
        return changed is None or any(name in changed for name in names)

    checks: dict[str, list[_Check]] = {name: [] for name in tables}
    for name, keys in UNIQUE_KEYS.items():
        if name in tables and due(name):
            checks[name].append(_Check(f"duplicate {name}", keys))
    for name, key, parent, parent_key in REFERENCES:
        if name in tables and due(name, parent) and (parent in tables or changed is not None):
            orphan = f"orphan {name}.{key}"
            checks[name].append(_Check(orphan, [key], where=F.col(key).isNotNull()))
            if parent in tables:
                checks[parent].append(_Check(orphan, [parent_key], known=True))
    for name, column, values in ALLOWED:
        if name in tables and due(name) and column in tables[name].columns:
            checks[name].append(_Check(f"unknown {name}.{column}", [column], where=~F.col(column).isin(list(values))))
    if "asset_versions" in tables and due("asset_versions"):
        checks["asset_versions"].append(_Check("several latest versions", ["asset_id"], where=F.col("is_latest")))
    return checks


def _said(tables: Mapping[str, DataFrame], checks: Mapping[str, list[_Check]]) -> DataFrame:
    """Rows (violation, key, label, _used, _known) of what each row says to its checks."""
    said = [
        tables[name].select(F.inline(F.array(*[check.row() for check in of_table])))
        for name, of_table in checks.items() if of_table and name in tables
    ]
    if not said:
        nothing = _Check("", next(iter(tables.values())).columns[:1])
        said = [next(iter(tables.values())).limit(0).select(F.inline(F.array(nothing.row())))]
    return reduce(DataFrame.union, said).where("violation IS NOT NULL")


def constraint_violations(
    tables: Mapping[str, DataFrame],
    before_versions: DataFrame | None = None,
    changed: Sequence[str] | None = None,
    touched: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Everything a database would have refused, as rows `violation, key, n`; empty when the state is sound.

    Keys compare NULL as a value, so a domain name may stand once without a URI. All checks share one grouping
    by (check, key): a key used twice is a duplicate, a key used but known nowhere an orphan, a value that is not among those a
    column may hold unknown. Each table is read once for all its checks, and uses fold on the map side, so neither the number of
    checks nor a hot key adds scans or shuffles.

    With `changed`, `tables` is a whole state: absent tables are empty, and only the checks a changed table takes
    part in are made.

    With `touched`, the rows of changed tables that were added, removed or altered (as they were and as they are), only keys that one
    of them uses or makes known are grouped; all others were sound before and have not moved. The checks of a changed table that is
    not in `touched` are made in full.
    """
    checks = _checks(tables, changed)
    if touched is None:
        said = _said(tables, checks)
    else:
        # What only the rows as they are now tell does not show what is gone, so checks of other changed tables are made in full.
        unknown = {name for name in (tables if changed is None else changed) if name not in touched}
        whole = {check.violation for name in unknown for check in checks.get(name, [])}
        in_full = {name: [c for c in of_table if c.violation in whole] for name, of_table in checks.items()}
        in_part = {name: [c for c in of_table if c.violation not in whole] for name, of_table in checks.items()}
        keys = _said(touched, {name: in_part.get(name, []) for name in touched}).select("violation", "key").distinct() if touched else None
        said = _said(tables, in_full)
        if keys is not None and any(in_part.values()):
            moved = _said(tables, in_part).join(keys, ["violation", "key"], "left_semi")
            said = moved.select(*said.columns).union(said) if any(in_full.values()) else moved.select(*said.columns)
    refused = (
        said.groupBy("violation", "key")
        .agg(F.any_value("label").alias("label"), F.sum("_used").alias("n"), F.sum("_known").alias("known"))
        .where(
            F.when(F.startswith("violation", F.lit("orphan")), (F.col("n") > 0) & (F.col("known") == 0))
            .when(F.startswith("violation", F.lit("unknown")), F.col("n") > 0)
            .otherwise(F.col("n") > 1)
        )
        .select("violation", F.col("label").alias("key"), "n")
    )
    if before_versions is None or "asset_versions" not in tables or (changed is not None and "asset_versions" not in changed):
        return refused
    versions = tables["asset_versions"] if touched is None or "asset_versions" not in touched else touched["asset_versions"]
    return refused.unionByName(renumbered(before_versions, versions))


# --- studies, assets, variables -------------------------------------------------------------------------------

def study_domains(links: DataFrame, domains: DataFrame) -> DataFrame:
    """Domains of every study, by study and name."""
    return links.select("study_id", "domain_id").join(domains, "domain_id").orderBy("study_id", "name")


def study_assets_latest(assets: DataFrame, versions: DataFrame) -> DataFrame:
    """Assets with their flagged version, its note and time as far as `versions` has them, by study and name."""
    more = [name for name in ("version_note", "doi", "created_at") if name in versions.columns]
    latest = versions.where("is_latest").select("asset_id", "version_id", *VERSION, version_label().alias("version_label"), *more)
    return assets.join(latest, "asset_id").orderBy("study_id", "name")


def study_versions(
    assets: DataFrame, versions: DataFrame, asset_type: str, include_versions: bool = False,
    details: DataFrame | None = None,
) -> DataFrame:
    """Dataset (or file) assets with their latest version, or with all of them.

    `details` adds what another table holds about a version: file metadata, or one row per variable.
    """
    if asset_type not in VT.ASSET_TYPES:
        raise ValueError(f"asset_type must be one of {VT.ASSET_TYPES}")
    wanted = versions if include_versions else latest_versions(versions)
    chosen = assets.where(F.col("asset_type") == asset_type).select("asset_id", "study_id", "name")
    found = wanted.select("asset_id", "version_id", *VERSION).join(chosen, "asset_id")
    return found if details is None else found.join(details, "version_id", "left")


def vocabulary_items_nested(vocabularies: DataFrame, items: DataFrame, key: str = "vocabulary_id") -> DataFrame:
    """Vocabularies with their items as one sorted list; an empty vocabulary keeps an empty list.

    A vocabulary's list is one cell of the result. Identical items are folded before the shuffle.
    """
    item = F.struct("value", "code", "description")
    lists = (
        items.select(key, "value", "code", "description").distinct()
        .groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    )
    empty = F.array().cast(VT.ITEMS_TYPE)
    return vocabularies.join(lists, key, "left").withColumn(
        "items", F.coalesce(F.col("items").cast(VT.ITEMS_TYPE), empty)
    )


def with_vocabulary(variables: DataFrame, vocabularies: DataFrame, key: str = "vocabulary_id") -> DataFrame:
    """Variables with the `items` of their vocabulary (a `vocabulary_items_nested` result); an empty list without one."""
    empty = F.array().cast(VT.ITEMS_TYPE)
    return variables.join(vocabularies.select(key, "items"), key, "left").select(
        *variables.columns, F.coalesce("items", empty).alias("items")
    )


def study_variables(
    variables: DataFrame, links: DataFrame, study_id: int | None = None, domain_id: int | None = None,
    vocabularies: DataFrame | None = None, key: str = "vocabulary_id",
) -> DataFrame:
    """Variables in the domains of a study (or of any study), optionally of one domain, and with their vocabularies' items."""
    if study_id is not None:
        links = links.where(F.col("study_id") == study_id)
    if domain_id is not None:
        links = links.where(F.col("domain_id") == domain_id)
    found = variables.join(links.select("domain_id").distinct(), "domain_id", "left_semi").select(*variables.columns)
    return found if vocabularies is None else with_vocabulary(found, vocabularies, key)


def dataset_variables(
    links: DataFrame, variables: DataFrame, vocabularies: DataFrame | None = None, key: str = "vocabulary_id"
) -> DataFrame:
    """Variables of each dataset version, optionally with their vocabularies' items."""
    described = variables if vocabularies is None else with_vocabulary(variables, vocabularies, key)
    return links.select("version_id", "variable_id").join(described, "variable_id")


def datasets_described(
    assets: DataFrame, versions: DataFrame, links: DataFrame, variables: DataFrame, vocabularies: DataFrame | None = None,
    include_versions: bool = False,
) -> DataFrame:
    """Datasets with their latest version, or all of them, and its variables as one list, in table order and then by name.

    `links(version_id, variable_id[, ordinal, keyrole])`; what a link does not say about its key role the variable does. With
    `vocabularies` (a `vocabulary_items_nested` result) each variable has its items. A version without variables has an empty list.
    The list of a version is one cell.
    """
    described = variables if vocabularies is None else with_vocabulary(variables, vocabularies)
    own = lambda name: F.col(f"l.{name}") if name in links.columns else F.lit(None)
    given = lambda name: F.col(f"v.{name}") if name in described.columns else F.lit(None)
    entry = F.struct(
        own("ordinal").cast("int").alias("ordinal"), F.col("v.name").alias("name"), F.col("v.variable_id").alias("variable_id"),
        given("value_type_id").cast("int").alias("value_type_id"), given("value_format").cast("string").alias("value_format"),
        F.coalesce(own("keyrole"), given("keyrole")).cast("string").alias("keyrole"), given("description").cast("string").alias("description"),
        *([F.col("v.items").alias("items")] if vocabularies is not None else []),
    )
    listed = links.alias("l").join(described.alias("v"), F.col("l.variable_id") == F.col("v.variable_id")).select("l.version_id", entry.alias("variable"))
    # Without an ordinal a variable comes last, as NULL sorts first.
    placed = F.struct(F.coalesce("variable.ordinal", F.lit(2**31 - 1)).alias("at"), F.col("variable.name").alias("name"), "variable")
    lists = listed.groupBy("version_id").agg(F.sort_array(F.collect_list(placed)).alias("placed"))
    found = study_versions(assets, versions, "dataset", include_versions).join(lists, "version_id", "left")
    kind = listed.schema["variable"].dataType.simpleString()
    nested = F.coalesce(F.transform("placed", lambda x: x["variable"]), F.array().cast(f"array<{kind}>"))
    return found.select("asset_id", "study_id", "name", "version_id", *VERSION, nested.alias("variables"))


# --- provenance -----------------------------------------------------------------------------------------------

def study_transformations(
    transformations: DataFrame,
    inputs: DataFrame,
    outputs: DataFrame,
    versions: DataFrame,
    assets: DataFrame,
    order: Sequence[str] = ("date_created", "transformation_id"),
) -> DataFrame:
    """Transformations that read or wrote any asset of a study, newest first."""
    edges = inputs.select("transformation_id", "version_id").union(outputs.select("transformation_id", "version_id"))
    touched = (
        edges.join(versions.select("version_id", "asset_id"), "version_id")
        .join(assets.select("asset_id", "study_id"), "asset_id")
        .select("study_id", "transformation_id").distinct()
    )
    return touched.join(transformations, "transformation_id").orderBy(
        "study_id", *[F.col(name).desc() for name in order]
    )


def checked_transformations(transformations: DataFrame) -> DataFrame:
    """Fails the query at the first transformation of an unknown type."""
    kind = F.col("transformation_type")
    message = F.concat(F.lit("unknown transformation type "), F.coalesce(kind, F.lit("NULL")))
    checked = F.when(kind.isin(*VT.TRANSFORMATION_TYPES), kind).otherwise(F.raise_error(message).cast("string"))
    return transformations.withColumn("transformation_type", checked)


def record_provenance(
    existing: Mapping[str, DataFrame], transformations: DataFrame, inputs: DataFrame, outputs: DataFrame
) -> dict[str, DataFrame]:
    """Provenance tables with new transformations and their edges appended; repeated edges are ignored."""
    edge = ["transformation_id", "version_id"]
    return {
        "transformations": existing["transformations"].unionByName(
            checked_transformations(transformations), allowMissingColumns=True
        ),
        "transformation_inputs": link_if_absent(existing["transformation_inputs"], inputs, edge),
        "transformation_outputs": link_if_absent(existing["transformation_outputs"], outputs, edge),
    }


def lineage(seeds: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Versions each seed was made from, with the fewest transformations in between.

    `seeds(version_id)` -> `seed_id, version_id, depth`. See `lineage_rounds`.
    """
    return lineage_rounds(seeds, inputs, outputs)[0]


def lineage_rounds(seeds: DataFrame, inputs: DataFrame, outputs: DataFrame) -> tuple[DataFrame, int]:
    """`lineage` and the rounds it took: about the logarithm of the greatest depth.

    Paths are doubled. After k rounds, what is less than 2^k transformations away from a seed is known, and there is a table of jumps
    of exactly 2^k transformations; each round lengthens what is known by the jumps and the jumps by themselves. Jumps lead from
    transformation to transformation, so the input-by-output pairs of a busy transformation are never formed. A round is written to
    the shared scratch folder. The loop ends when a round finds nothing new: on a shortest path nothing lies beyond a gap, so cycles
    end it too.
    """
    wrote = outputs.select("version_id", "transformation_id").distinct()
    read = materialize(inputs.select("transformation_id", "version_id").distinct(), "lineage-inputs")
    start = seeds.select("version_id").distinct().join(wrote, "version_id")
    known = start.select(F.col("version_id").alias("seed_id"), "transformation_id", F.lit(0).cast("bigint").alias("steps"))
    known = materialize(known, "lineage")
    made_by = wrote.select("version_id", F.col("transformation_id").alias("to"))
    jumps = materialize(read.join(made_by, "version_id").select("transformation_id", "to").distinct(), "lineage-jumps")
    rounds = 0
    while True:
        length = 2**rounds
        rounds += 1
        ahead = known.join(jumps, "transformation_id").select("seed_id", F.col("to").alias("transformation_id"), "steps")
        ahead = ahead.groupBy("seed_id", "transformation_id").agg((F.min("steps") + length).alias("steps"))
        fresh = materialize(ahead.join(known, ["seed_id", "transformation_id"], "left_anti"), "lineage")
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
        beyond = jumps.select(F.col("transformation_id").alias("to"), F.col("to").alias("beyond"))
        jumps = materialize(jumps.join(beyond, "to").select("transformation_id", F.col("beyond").alias("to")).distinct(), "lineage-jumps")
    found = known.join(read, "transformation_id").groupBy("seed_id", "version_id").agg((F.min("steps") + 1).cast("int").alias("depth"))
    return found.where("seed_id <> version_id"), rounds


# --- seeds ----------------------------------------------------------------------------------------------------

def value_types(spark) -> DataFrame:
    return local_rows(spark, VT.VALUE_TYPES, "value_type_id INT, value_type STRING, description STRING")


def study_types(spark) -> DataFrame:
    return local_rows(
        spark, VT.STUDY_TYPES, "study_type_id INT, name STRING, description STRING, namespace STRING, ontology_class STRING"
    )


def value_type_usage(variables: DataFrame) -> DataFrame:
    """The seeded value types with the number of variables that use each."""
    used = variables.groupBy("value_type_id").agg(F.count(F.lit(1)).alias("n_variables"))
    return value_types(variables.sparkSession).join(used, "value_type_id", "left").fillna(0, ["n_variables"])


def study_type_usage(studies: DataFrame) -> DataFrame:
    """The seeded study types with the number of studies of each."""
    used = studies.groupBy("study_type_id").agg(F.count(F.lit(1)).alias("n_studies"))
    return study_types(studies.sparkSession).join(used, "study_type_id", "left").fillna(0, ["n_studies"])
