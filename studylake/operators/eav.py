"""Long `(record, field_name, value)` exports -> wide, typed tables.

One identity keeps the plan short: a field with one row per record joins to exactly that row's value, so joining
values per (record, field) is right for single-valued and multi-valued fields alike. The wide table therefore
needs no pass that first finds out which fields are multi-valued, and no self join.

Skew: rows are first counted per (record, field, value). That aggregation combines on the map side and spreads a
hot record or field over all its values, so only distinct values travel on.

Widening: a record's cells are collected into one array, sorted, cut into runs of one field and padded with the
fields it lacks; column i of the table is then element i. The work grows with the cells and columns of a record,
where a pivot tests each row against each column.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.functions.values import cast_integer, typed_columns
from studylake.session import spread
from studylake.types import Variable

RECORD = ("record",)


def field_names(eav: DataFrame) -> DataFrame:
    """Distinct field names, ordered."""
    return eav.select("field_name").distinct().orderBy("field_name")


def counts(eav: DataFrame, keys: Sequence[str] = RECORD) -> DataFrame:
    """Rows per (record, field); NULL values count too."""
    return eav.groupBy(*keys, "field_name").agg(F.count(F.lit(1)).alias("n"))


def multi_fields(eav: DataFrame, keys: Sequence[str] = RECORD) -> DataFrame:
    """Fields with more than one row in any record."""
    most = counts(eav, keys).groupBy("field_name").agg(F.max("n").alias("most"))
    return most.where("most > 1").select("field_name")


def single_rows(eav: DataFrame, multi: DataFrame | None = None) -> DataFrame:
    """Rows of the fields that are never multi-valued."""
    multi = multi_fields(eav) if multi is None else multi
    return _without(eav, F.broadcast(multi)).select(*eav.columns)


def _without(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose field is not among `names`, each of which stands there once.

    Not an anti join: Spark moves those below a union, where a branch of one field has no key left to join on.
    """
    return rows.join(names.select("field_name", F.lit(True).alias("_named")), "field_name", "left").where("_named IS NULL").drop("_named")


def joined_values(eav: DataFrame, keys: Sequence[str] = RECORD) -> DataFrame:
    """One row per (record, field): the values joined with `', '` in value order, NULLs skipped."""
    return _join_distinct(_distinct_values(eav, keys), keys)


def _distinct_values(eav: DataFrame, keys: Sequence[str]) -> DataFrame:
    return eav.groupBy(*keys, "field_name", "value").agg(F.count(F.lit(1)).cast("int").alias("n"))


def _join_distinct(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    repeated = F.when(F.col("value").isNotNull(), _written_out(F.col("value"), F.col("n")))
    return (
        spread(values.withColumn("repeated", repeated), *map(_backticked, keys), "field_name").groupBy(*keys, "field_name")
        .agg(F.expr("listagg(repeated, ', ') WITHIN GROUP (ORDER BY value)").alias("value"))
    )


def _written_out(value: Column, n: Column) -> Column:
    """A value as often as it occurred."""
    return F.when(n == 1, value).otherwise(F.array_join(F.array_repeat(value, n), ", "))


def multi_agg(eav: DataFrame, multi: DataFrame | None = None) -> DataFrame:
    """Joined values of the multi-valued fields."""
    multi = multi_fields(eav) if multi is None else multi
    # Names stand once, so an inner join takes no row twice; a semi join would be moved below a union (see `_without`). Names are
    # columns of the wide table and so few; a shuffle by name would leave the whole export to as many tasks as there are fields.
    return joined_values(eav.join(F.broadcast(multi.select("field_name")), "field_name"))


def prepped(eav: DataFrame) -> DataFrame:
    """One row per (record, field): a single value as it is, several joined.

    A field with one row in a record joins to exactly that row's value, so one pass serves both kinds of field.
    """
    return joined_values(eav).select("record", "field_name", "value")


def column_names(eav: DataFrame) -> list[str]:
    """Field names as the columns of a wide table, all of them."""
    return [row.field_name for row in field_names(eav.where(F.col("field_name").isNotNull())).collect()]


def pivot(rows: DataFrame, fields: Sequence[str], keys: Sequence[str] = RECORD) -> DataFrame:
    """One row per record, one column per field, its (smallest) non-null value.

    Values fold per (record, field) on the map side first, so a hot record travels as one row for each of its fields.
    """
    smallest = _of_fields(rows, fields, keys).groupBy(*keys, "field_name").agg(F.min("value").alias("value"))
    cells = smallest.repartition(*keys).withColumn("n", F.lit(1))
    return _widen(_collect_cells(cells, keys), fields, keys, lambda run: run[0]["value"])


def _of_fields(rows: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows of other fields only keep their record alive: without field and value they fold to one row per record."""
    known = F.col("field_name").isin(list(fields))
    return rows.select(
        *keys, F.when(known, F.col("field_name")).alias("field_name"), F.when(known, F.col("value")).alias("value")
    )


def _collect_cells(values: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """One row per record with its cells in field and value order; cells without field or value are left out."""
    usable = F.col("field_name").isNotNull() & F.col("value").isNotNull()
    cell = F.when(usable, F.struct("field_name", "value", "n"))
    return values.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("cells"), *more)


def _joined_run(run: Column) -> Column:
    """The cells of one field as text."""
    texts = F.transform(run, lambda c: _written_out(c["value"], c["n"]))
    return F.when(F.size(run) == 1, texts[0]).otherwise(F.array_join(texts, ", "))


def _widen(
    records: DataFrame, fields: Sequence[str], keys: Sequence[str], text_of_run: Callable[[Column], Column]
) -> DataFrame:
    """Sorted cells of these fields -> one column per field.

    Each step is a column of its own, so it is evaluated once per record.
    """
    if not fields:
        return records.select(*keys)
    cells = F.col("cells")
    starts = F.filter(
        F.transform(
            cells,
            lambda c, i: F.when((i == 0) | (F.get(cells, i - 1)["field_name"] != c["field_name"]), i + 1),
        ),
        lambda start: start.isNotNull(),
    )
    cut = records.select(*keys, "cells", starts.alias("starts"))

    def entry(name: Column, value: Column) -> Column:
        return F.struct(name.alias("field_name"), value.alias("value"))

    def run_entry(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col("starts"), i + 1), F.size(cells) + 1)
        run = F.slice(cells, start, end - start)
        return F.transform(F.array(run), lambda r: entry(r[0]["field_name"], text_of_run(r)))[0]

    present = cut.select(*keys, F.transform("starts", run_entry).alias("entries"))
    order = sorted(set(fields), key=lambda name: name.encode())
    absent = F.array_except(F.array(*[F.lit(name) for name in order]), F.transform("entries", lambda e: e["field_name"]))
    padding = F.transform(absent, lambda name: entry(name, F.lit(None).cast("string")))
    full = present.select(*keys, F.sort_array(F.concat("entries", padding)).alias("full"))
    place = {name: i for i, name in enumerate(order)}
    # One text per column: building thousands of them as objects takes longer than running them.
    return full.selectExpr(*map(_backticked, keys), *[f"full[{place[name]}].value AS {_backticked(name)}" for name in fields])


def wide_raw(
    eav: DataFrame, fields: Sequence[str] | None = None, keys: Sequence[str] = RECORD, ordered: bool = False
) -> DataFrame:
    """Whole pipeline without typing. Two shuffles: distinct values, then by record.

    With `fields` given the discovery job is skipped and the values of other fields are dropped before the
    shuffle; records stay even if none of their fields is kept. `ordered` adds a global sort for presentation.
    """
    if fields is None:
        fields = column_names(eav)
    values = _distinct_values(_of_fields(eav, fields, keys), keys).repartition(*keys)
    wide = _widen(_collect_cells(values, keys), fields, keys, _joined_run)
    return wide.orderBy(*keys) if ordered else wide


def variable_match(fields: DataFrame, variables: DataFrame) -> DataFrame:
    """Discovered fields with their variables, joined on name."""
    return fields.select("field_name").distinct().join(
        variables.withColumnRenamed("name", "field_name"), "field_name"
    )


def duplicate_matches(fields: DataFrame, variables: DataFrame) -> DataFrame:
    """Fields that match variables of several domains; they would give duplicate columns."""
    return (
        variable_match(fields, variables).groupBy("field_name").agg(F.count(F.lit(1)).alias("n_variables"))
        .where("n_variables > 1")
    )


def unmatched_fields(fields: DataFrame, variables: DataFrame) -> DataFrame:
    """Fields no variable describes; they are left out of the typed table."""
    names = variables.select(F.col("name").alias("field_name")).distinct()
    return _without(fields.select("field_name").distinct(), names)


def variable_list(matched: DataFrame) -> list[Variable]:
    """Matched variables as a projection list, ordered by name."""
    rows = matched.select("field_name", "value_type_id", "value_format").orderBy("field_name").collect()
    repeated = sorted(name for name, n in Counter(row.field_name for row in rows).items() if n > 1)
    if repeated:
        raise ValueError(f"variables defined in several domains: {repeated}")
    return [Variable(row.field_name, row.value_type_id, row.value_format) for row in rows]


def wide_typed(
    eav: DataFrame,
    variables: Sequence[Variable],
    integer_record: bool = True,
    multiresponse_as_array: bool = False,
    as_time: bool = False,
    ordered: bool = False,
    keys: Sequence[str] = RECORD,
) -> DataFrame:
    """Whole pipeline, typed by variable: one column per variable, `<name>_raw` beside each category.

    With more `keys` than the record, as longitudinal exports have them, there is a row for each of their values; they stay text.
    """
    raw = wide_raw(eav, [variable.name for variable in variables], keys)
    key_columns = [
        cast_integer(F.col(key)).alias(key) if integer_record and key == "record" else _quoted(key) for key in keys
    ]
    wide = raw.select(*key_columns, *typed_columns(list(variables), multiresponse_as_array, as_time))
    return wide.orderBy(*keys) if ordered else wide


def record_digests(eav: DataFrame, keys: Sequence[str] = RECORD) -> DataFrame:
    """`<keys>, n, total, mixed` of each record: a digest of its rows that doesn't depend on their order."""
    hashed = [F.xxhash64(F.lit(seed), F.col("field_name"), F.col("value").isNull(), F.col("value")) for seed in (1, 2)]
    rows = eav.select(*map(_quoted, keys), hashed[0].cast("decimal(38,0)").alias("_one"), hashed[1].alias("_two"))
    return rows.groupBy(*map(_quoted, keys)).agg(F.count(F.lit(1)).alias("n"), F.sum("_one").alias("total"), F.bit_xor("_two").alias("mixed"))


def flat_named_multi(eav: DataFrame, multi: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """Variant with the multi-valued fields named by the caller; `record` is dropped.

    Named fields are joined with `', '`, other fields keep their smallest value, and only records with some
    other field appear. Everything comes from one grouping by record instead of a pivot and a join back.
    """
    if fields is None:
        fields = [name for name in column_names(eav) if name not in set(multi)]
    named = list(multi)
    columns = [*fields, *named]
    # Only records with a row of some other field appear; an unnamed row does not count as one.
    others = F.coalesce(F.bool_or(~F.col("field_name").isin(named)), F.lit(False)).alias("others")
    values = _distinct_values(eav, RECORD).repartition("record")
    records = _collect_cells(values, RECORD, others).where("others")
    kept = records.withColumn("cells", F.filter("cells", lambda c: c["field_name"].isin(columns)))

    def text_of_run(run: Column) -> Column:
        return F.when(run[0]["field_name"].isin(named), _joined_run(run)).otherwise(run[0]["value"])

    return _widen(kept, columns, RECORD, text_of_run).select(*[_quoted(name) for name in columns])


def partial_typed(wide: DataFrame, casts: Sequence[Variable]) -> DataFrame:
    """Chosen columns typed and moved to the front, all others passed through."""
    chosen = {variable.name for variable in casts}
    return wide.select(*typed_columns(list(casts)), *[_quoted(name) for name in wide.columns if name not in chosen])


def _backticked(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _quoted(name: str) -> Column:
    return F.col(_backticked(name))
