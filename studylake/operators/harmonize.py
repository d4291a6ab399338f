"""Harmonised variables, recoded categories, entity instances and study access.

The data model declares these tables without saying how they are applied; the semantics below are this library's.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake.operators.classes import equivalence_classes
from studylake.operators.ids import assign_ids
from studylake.operators.intervals import containing_join, overlap_join
from studylake.session import spread

COMPARISONS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v,
}


class MappingRule(NamedTuple):
    """`destination` is derived from `source`; `prerequisite` must hold for the rule to apply."""

    destination: str
    source: str
    operator: str
    operands: str
    prerequisite: str | None = None


def mapping_rules(mapping: DataFrame, variables: DataFrame) -> list[MappingRule]:
    """Rules of a variable mapping table, with variable ids replaced by names, in mapping order.

    `mapping(mapping_id, from_variable_id, to_variable_id, operator, operants, prerequisite_id)`. Rules become
    columns of a projection, all of them.
    """
    names = variables.select("variable_id", "name")
    named = mapping
    for column, out in (("to_variable_id", "destination"), ("from_variable_id", "source"), ("prerequisite_id", "prerequisite")):
        lookup = names.select(F.col("variable_id").alias(column), F.col("name").alias(out))
        named = named.join(lookup, column, "left")
    rows = named.select("mapping_id", "destination", "source", "operator", "operants", "prerequisite", "prerequisite_id")
    rows = rows.orderBy("mapping_id").collect()
    for row in rows:
        if row.destination is None or row.source is None or (row.prerequisite is None and row.prerequisite_id is not None):
            raise ValueError(f"mapping {row.mapping_id} names an unknown variable")
    return [MappingRule(row.destination, row.source, row.operator, row.operants, row.prerequisite) for row in rows]


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _split(text: str, separator: str, times: int = -1) -> list[str]:
    """`text` at its separators; one behind a backslash is part of the text, as is a backslash behind another."""
    parts, at = [""], 0
    while at < len(text):
        if text[at] == "\\" and at + 1 < len(text):
            parts[-1] += text[at : at + 2]
            at += 1
        elif text[at] == separator and len(parts) != times + 1:
            parts.append("")
        else:
            parts[-1] += text[at]
        at += 1
    return parts


def _operand(text: str) -> str:
    """An operand as it is meant: without blanks around it and the backslashes before escaped characters."""
    return re.sub(r"\\(.)", r"\1", text.strip(), flags=re.DOTALL)


def _compared(source: Column, kind: T.DataType, derived: bool, operator: str, operand: str) -> Column:
    value = F.lit(operand)
    if not derived:
        return COMPARISONS[operator](source, value.cast(kind))
    # Derived variables are text: they are ordered as numbers where the operand is one.
    if operator in ("eq", "ne") or not re.fullmatch(r"[+-]?\d+(\.\d+)?", operand):
        return COMPARISONS[operator](source, value)
    return COMPARISONS[operator](source.try_cast("double"), value.cast("double"))


def _rule_value(df: DataFrame, rule: MappingRule, derived: bool) -> Column:
    source = _quoted(rule.source)
    kind = df.schema[rule.source].dataType
    if rule.operator == "map":
        value = F
        for pair in _split(rule.operands, "|"):
            key, mapped = map(_operand, _split(pair, "=", 1))
            value = value.when(source.cast("string") == key, F.lit(mapped))
        value = value.otherwise(None)
    else:
        if rule.operator == "contains":
            holds = F.contains(source.cast("string"), F.lit(_operand(rule.operands) if "\\" in rule.operands else rule.operands))
        elif rule.operator == "between":
            low, high = map(_operand, _split(rule.operands, ","))
            holds = _compared(source, kind, derived, "ge", low) & _compared(source, kind, derived, "le", high)
        elif rule.operator in COMPARISONS:
            holds = _compared(source, kind, derived, rule.operator, _operand(rule.operands) if "\\" in rule.operands else rule.operands)
        else:
            raise ValueError(f"unknown operator {rule.operator!r}")
        value = F.when(holds, "1").when(~holds, "0")
    if rule.prerequisite is None:
        return value
    # A prerequisite holds when it is neither NULL, nor empty, nor zero.
    return F.when(~F.coalesce(_quoted(rule.prerequisite).cast("string"), F.lit("0")).isin("", "0", "0.0", "false"), value)


def rule_layers(rules: Sequence[MappingRule], columns: Sequence[str]) -> list[list[str]]:
    """Destinations in layers: each needs only `columns` and destinations of earlier layers.

    A name that is a column is that column. Rules that need each other are refused, and a cycle of them is named.
    """
    given = set(columns)
    destinations = list(dict.fromkeys(rule.destination for rule in rules))
    needs: dict[str, set[str]] = {name: set() for name in destinations}
    for rule in rules:
        for name in (rule.source, rule.prerequisite):
            if name is not None and name not in given:
                if name not in needs:
                    raise ValueError(f"{rule.destination!r} needs {name!r}, which is neither a column nor derived")
                needs[rule.destination].add(name)
    layers: list[list[str]] = []
    done: set[str] = set()
    while len(done) < len(destinations):
        layer = [name for name in destinations if name not in done and needs[name] <= done]
        if not layer:
            at = next(name for name in destinations if name not in done)
            path = []
            while at not in path:
                path.append(at)
                at = min(needs[at] - done)
            raise ValueError(f"rules need each other: {' <- '.join([*path[path.index(at):], at])}")
        layers.append(layer)
        done |= set(layer)
    return layers


def apply_variable_mapping(df: DataFrame, rules: Sequence[MappingRule], keep: Sequence[str]) -> DataFrame:
    """Destination variables beside the kept columns, one projection for each layer of rules.

    Comparisons give '1' or '0', NULL when the source is NULL. Where several rules feed one destination, any '1'
    wins over '0'; `map` rules are tried in order and come before comparisons. A rule may read a variable that other rules derive, as
    its source or prerequisite, unless `df` has a column of that name. In operands a backslash makes `,`, `|`, `=` and itself part of
    a value.
    """
    destinations: dict[str, list[MappingRule]] = {}
    for rule in rules:
        destinations.setdefault(rule.destination, []).append(rule)
    own = set(df.columns)
    # Derived columns get names of their own until the end, so that none hides a column.
    place = {name: f"_derived{i}" for i, name in enumerate(destinations)}

    def placed(name: str | None) -> str | None:
        return place[name] if name is not None and name not in own else name

    for layer in rule_layers(rules, df.columns):
        derived = {}
        for name in layer:
            group = [rule._replace(source=placed(rule.source), prerequisite=placed(rule.prerequisite)) for rule in destinations[name]]
            values = [(rule.operator == "map", _rule_value(df, rule, rule.source not in own)) for rule in group]
            mapped, compared = [v for is_map, v in values if is_map], [v for is_map, v in values if not is_map]
            if len(compared) > 1:
                compared = [F.greatest(*compared)]
            derived[place[name]] = F.coalesce(*mapped, *compared).cast("string")
        df = df.withColumns(derived)
    return df.select(*map(_quoted, keep), *[F.col(place[name]).alias(name) for name in destinations])


def recode_table(mapping: DataFrame, from_items: DataFrame, to_items: DataFrame) -> DataFrame:
    """`from_value -> to_value` of a vocabulary mapping between item ids."""
    source = from_items.select(F.col("vocabulary_item_id").alias("from_item"), F.col("value").alias("from_value"))
    target = to_items.select(F.col("vocabulary_item_id").alias("to_item"), F.col("value").alias("to_value"))
    return mapping.join(source, "from_item").join(target, "to_item").select("from_value", "to_value")


def recode_vocabulary(
    df: DataFrame, column: str, mapping: DataFrame, from_items: DataFrame, to_items: DataFrame, out: str
) -> DataFrame:
    """Translate a category column into another vocabulary; values without a counterpart become NULL.

    A value with several counterparts fails the query and is named: rows never multiply.
    """
    return _translated(df, column, recode_table(mapping, from_items, to_items), out)


def _translated(df: DataFrame, column: str, counterparts: DataFrame, out: str) -> DataFrame:
    table = counterparts.groupBy("from_value").agg(F.min("to_value").alias("_least"), F.max("to_value").alias("_most"))
    several = F.concat(F.lit("several counterparts of "), F.col("from_value").cast("string"))
    single = F.when(F.col("_least").eqNullSafe(F.col("_most")), F.col("_least")).otherwise(F.raise_error(several).cast("int"))
    table = table.select("from_value", single.cast(table.schema["_least"].dataType).alias("_to"))
    return df.join(table, df[column] == table["from_value"], "left").select(
        *[df[name] for name in df.columns], F.col("_to").alias(out)
    )


def item_classes(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """`vocabulary_item_id, vocabulary_id, value, class_id` of all items: those that mappings lead to from each other are one class.

    `mapping(from_vocabulary_item, to_vocabulary_item)` says that two items mean the same, whatever the direction and over as many
    vocabularies as it takes. A class is named by its smallest item; an item no mapping names is a class of its own.
    """
    classes = equivalence_classes(mapping, "from_vocabulary_item", "to_vocabulary_item").withColumnRenamed("item", "vocabulary_item_id")
    own = items.select("vocabulary_item_id", "vocabulary_id", "value").join(classes, "vocabulary_item_id", "left")
    return own.withColumn("class_id", F.coalesce("class_id", F.col("vocabulary_item_id").cast(classes.schema["class_id"].dataType)))


def representatives(classes: DataFrame, preferred: Sequence[int] = ()) -> DataFrame:
    """`class_id, vocabulary_item_id, vocabulary_id, value`: one item for each class of `item_classes`.

    It is of the first preferred vocabulary that has an item in the class, and otherwise the smallest; among several the smallest.
    """
    rank = F.coalesce(*[F.when(F.col("vocabulary_id") == v, i) for i, v in enumerate(preferred)], F.lit(len(preferred)))
    chosen = F.min_by(F.struct("vocabulary_item_id", "vocabulary_id", "value"), F.struct(rank, "vocabulary_item_id"))
    return classes.groupBy("class_id").agg(chosen.alias("item")).select("class_id", "item.*")


def class_conflicts(classes: DataFrame) -> DataFrame:
    """`class_id, vocabulary_id, n_items, first_item, last_item` of classes that make different items of one vocabulary the same."""
    counted = classes.groupBy("class_id", "vocabulary_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("vocabulary_item_id").alias("first_item"), F.max("vocabulary_item_id").alias("last_item")
    )
    return counted.where("n_items > 1")


def recode_between(df: DataFrame, column: str, classes: DataFrame, from_vocabulary: int, to_vocabulary: int, out: str) -> DataFrame:
    """Translate a category column of one vocabulary into any other that `item_classes` connects with it, directly or not.

    Values without a counterpart become NULL; one with several fails the query and is named.
    """
    def of(vocabulary: int, name: str) -> DataFrame:
        return classes.where(F.col("vocabulary_id") == vocabulary).select("class_id", F.col("value").alias(name))

    return _translated(df, column, of(from_vocabulary, "from_value").join(of(to_vocabulary, "to_value"), "class_id"), out)


def decode_categories(df: DataFrame, column: str, items: DataFrame, key: str = "value") -> DataFrame:
    """Code and description beside a category column."""
    lookup = items.select(
        F.col(key).alias("_key"), F.col("code").alias(f"{column}_code"),
        F.col("description").alias(f"{column}_description"),
    )
    return df.join(lookup, df[column] == lookup["_key"], "left").drop("_key")


def extract_entity_instances(
    df: DataFrame, entity_id: int, study_id: str, external_id: str, transformation_id: int,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Distinct external ids per study as numbered instances; ids already in `existing` are left out."""
    seen = df.select(
        F.lit(entity_id).cast("bigint").alias("entity_id"),
        F.col(study_id).cast("bigint").alias("study_id"),
        F.col(external_id).cast("string").alias("external_id"),
    ).where("external_id IS NOT NULL").distinct()
    keys = ["entity_id", "study_id", "external_id"]
    if existing is not None:
        seen = seen.join(existing.select(*keys), keys, "left_anti")
    numbered = assign_ids(seen, keys, "instance_id", existing)
    return numbered.withColumn("transformation_id", F.lit(transformation_id).cast("bigint"))


def extract_relation_instances(
    df: DataFrame, subject: str, object_: str, at: str, subjects: DataFrame, objects: DataFrame,
    relation_id: int, transformation_id: int, study_id: str = "study_id",
) -> DataFrame:
    """One row per related pair and study with the first and last date it was seen.

    `study_id` names the study's column in `df`; instances (`study_id, external_id, instance_id`, of one entity each) are those
    of the same study, for external ids are only unique within one.
    """
    keys = (F.col(study_id).cast("bigint").alias("_study"), F.col(subject).cast("string").alias("_s"), F.col(object_).cast("string").alias("_o"))
    pairs = df.groupBy(*keys).agg(F.min(F.to_date(at)).alias("valid_from"), F.max(F.to_date(at)).alias("valid_to"))
    study = F.col("study_id").cast("bigint").alias("_study")
    left = subjects.select(study, F.col("external_id").alias("_s"), F.col("instance_id").alias("entity_instance_id_1"))
    right = objects.select(study, F.col("external_id").alias("_o"), F.col("instance_id").alias("entity_instance_id_2"))
    return pairs.join(left, ["_study", "_s"]).join(right, ["_study", "_o"]).select(
        F.lit(relation_id).cast("bigint").alias("entity_relation_id"),
        F.col("entity_instance_id_1").cast("bigint").alias("entity_instance_id_1"),
        F.col("entity_instance_id_2").cast("bigint").alias("entity_instance_id_2"), "valid_from", "valid_to",
        F.lit(transformation_id).cast("bigint").alias("transformation_id"),
    )


def relations_valid_at(relations: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """Relations valid on a day, or overlapping a period; both ends count."""
    first, last = F.lit(start).cast("date"), F.lit(end or start).cast("date")
    return relations.where((F.col("valid_from") <= last) & (F.col("valid_to") >= first))


def relations_valid_in_periods(relations: DataFrame, periods: DataFrame, first: str, last: str) -> DataFrame:
    """Each relation beside each period it overlaps; both ends count, and relations or periods without an end match nothing.

    Columns of relations and periods must differ in name.
    """
    return overlap_join(relations, periods, ("valid_from", "valid_to"), (first, last))


def relations_valid_on_days(relations: DataFrame, days: DataFrame, day: str) -> DataFrame:
    """Each relation beside each row of `days` whose date lies in it."""
    return containing_join(relations, days, ("valid_from", "valid_to"), day)


def asset_entities(
    rows: DataFrame, asset_id: str, external_id: str, instances: DataFrame, study_id: str = "study_id"
) -> DataFrame:
    """Which instances of the asset's study occur in which asset; `study_id` names the study's column in `rows`."""
    keys = ["study_id", "external_id"]
    used = rows.select(
        F.col(asset_id).alias("asset_id"), F.col(study_id).cast("bigint").alias("study_id"),
        F.col(external_id).cast("string").alias("external_id"),
    )
    known = instances.select(
        F.col("study_id").cast("bigint").alias("study_id"), "external_id", F.col("instance_id").alias("entity_instance_id")
    )
    used = spread(used, "asset_id", *keys).distinct()
    return spread(used.join(known, keys).select("asset_id", "entity_instance_id"), "asset_id", "entity_instance_id").distinct()


def accessible_studies(rows: DataFrame, access: DataFrame, user_id: str, levels: Sequence[str] | None = None) -> DataFrame:
    """Rows of the studies a user may see, optionally at certain access levels."""
    granted = access.where(F.col("user_id") == user_id)
    if levels:
        granted = granted.where(F.col("access_level").isin(list(levels)))
    return rows.join(granted.select("study_id").distinct(), "study_id", "left_semi").select(*rows.columns)
