"""Keys and references found in data, for databases that declare none.

Tables are first turned into rows (column, value), a batch of tables to a job, so that what follows is one plan over rows however many
tables there are. Columns are numbered from the schemas; only those numbers, names and types are held by the driver.

- **References.** Equal values meet once: each value gives the set of columns that hold it. Different sets are few compared with
  values. What a column's sets have in common, as bits, are the columns that hold all of its values.
- **Keys.** Level by level: equal rows are first looked for in one slice of the values by hash, which holds all rows of a value or none,
  so a combination that repeats there is no key; those left are counted in full; a combination that contains a key is not looked at again.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake.session import local_rows, scratch_path

#: Tables whose scans are put into one plan.
BATCH = 32
#: Texts longer than this travel as digests.
LONG = 64
#: Columns that share one number of a bit set.
WORD = 62
#: A combination is first looked at in one slice of its values out of so many.
SLICES = 256
KINDS = ("integer", "text")


class ColumnOf(NamedTuple):
    number: int
    table_name: str
    column_name: str
    kind: str


def kind_of(data_type: T.DataType) -> str | None:
    if isinstance(data_type, T.IntegralType):
        return "integer"
    return "text" if isinstance(data_type, T.StringType) else None


def columns_of(tables: Mapping[str, DataFrame], kinds: Sequence[str] = KINDS) -> list[ColumnOf]:
    """Integer and text columns of all tables, numbered."""
    found = [(name, f.name, kind_of(f.dataType)) for name, df in tables.items() for f in df.schema.fields if kind_of(f.dataType) in kinds]
    return [ColumnOf(i, *column) for i, column in enumerate(found)]


def stacked(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of many frames of one schema. More than a batch of them are written to the shared scratch folder batch by batch."""
    parts = list(parts)
    if len(parts) <= BATCH:
        return reduce(DataFrame.unionByName, parts)
    spark = parts[0].sparkSession
    path = scratch_path(spark, name)
    for i in range(0, len(parts), BATCH):
        reduce(DataFrame.unionByName, parts[i : i + BATCH]).write.mode("append").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _short(value: Column) -> Column:
    """A text as it is, or its digest behind a byte that makes it longer than any text that is kept."""
    return F.when(F.octet_length(value) <= LONG, value).otherwise(F.concat(F.lit("\0"), F.sha2(value, 256)))


def _held(df: DataFrame, columns: Sequence[ColumnOf]) -> DataFrame:
    """(number, kind, value): the distinct values of a table's columns, without NULL."""
    cells = [
        F.struct(
            F.lit(c.number).alias("number"), F.lit(c.kind).alias("kind"),
            (_short(_quoted(c.column_name)) if c.kind == "text" else _quoted(c.column_name).cast("string")).alias("value"),
        )
        for c in columns
    ]
    return df.select(F.inline(F.array(*cells))).where("value IS NOT NULL").distinct()


def _by_table(columns: Sequence[ColumnOf]) -> dict[str, list[ColumnOf]]:
    out: dict[str, list[ColumnOf]] = {}
    for column in columns:
        out.setdefault(column.table_name, []).append(column)
    return out


def included(tables: Mapping[str, DataFrame], columns: Sequence[ColumnOf]) -> DataFrame:
    """(number, ref): columns whose every value also occurs in column `ref` of the same kind; columns without values are left out."""
    parts = [_held(tables[name], own) for name, own in _by_table(columns).items()]
    # One row per value and per set: a value that every column holds is a set of all columns, not a hot group.
    sets = stacked(parts, "column-values").groupBy("kind", "value").agg(F.sort_array(F.collect_set("number")).alias("numbers"))
    sets = sets.select("numbers").distinct()
    words = -(-(columns[-1].number + 1) // WORD)
    bits = f"aggregate(filter(numbers, n -> n div {WORD} = w), 0L, (a, n) -> a | shiftleft(1L, CAST(n % {WORD} AS INT)))"
    spread = sets.select(F.explode("numbers").alias("number"), F.expr(f"transform(sequence(0, {words - 1}), w -> {bits})").alias("words"))
    spread = spread.select("number", F.posexplode("words").alias("at", "word"))
    common = spread.groupBy("number", "at").agg(F.bit_and("word").alias("word"))
    refs = F.expr(f"filter(transform(sequence(0, {WORD - 1}), b -> IF(word & shiftleft(1L, b) <> 0, at * {WORD} + b, NULL)), r -> r IS NOT NULL)")
    return common.select("number", F.explode(refs).alias("ref")).where("number <> ref")


def inclusion_dependencies(tables: Mapping[str, DataFrame], columns: Sequence[ColumnOf] | None = None) -> DataFrame:
    """`table_name, column_name, ref_table, ref_column` of all pairs of columns where the second holds every value of the first.

    Integers are compared with integers and texts with texts; NULL is no value, and a column without values refers to nothing.
    """
    columns = columns_of(tables) if columns is None else list(columns)
    spark = next(iter(tables.values())).sparkSession
    if not columns:
        return local_rows(spark, [], "table_name string, column_name string, ref_table string, ref_column string")
    names = local_rows(spark, [tuple(c[:3]) for c in columns], "number int, table_name string, column_name string")
    refs = names.select(F.col("number").alias("ref"), F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"))
    found = included(tables, columns).join(names, "number").join(refs, "ref")
    return found.select("table_name", "column_name", "ref_table", "ref_column")


def within_range(tables: Mapping[str, DataFrame], columns: Sequence[ColumnOf], low: int, high: int) -> list[ColumnOf]:
    """Integer columns that hold values, all of them between `low` and `high`: one row of bounds a table."""
    parts = []
    for name, own in _by_table(columns).items():
        bounds = [
            F.struct(F.lit(c.number).alias("number"), F.min(_quoted(c.column_name)).cast("bigint").alias("low"), F.max(_quoted(c.column_name)).cast("bigint").alias("high"))
            for c in own
        ]
        parts.append(tables[name].agg(F.array(*bounds).alias("bounds")).select(F.inline("bounds")))
    inside = stacked(parts, "column-bounds").where((F.col("low") >= low) & (F.col("high") <= high)).select("number")
    numbers = {row.number for row in inside.collect()}
    return [c for c in columns if c.number in numbers]


# --- keys -----------------------------------------------------------------------------------------------------

Combination = tuple[str, ...]


def _key_columns(df: DataFrame) -> list[str]:
    """Columns a key can be made of: those whose values can be grouped, without floating numbers and nested values."""
    kinds = (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.BooleanType, T.BinaryType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def _combined(df: DataFrame, level: Sequence[Combination]) -> DataFrame:
    """A row for each row and combination of columns without NULL: its place in `level` and two hashes of the row's values.

    Each column is hashed once, however many combinations it is part of.
    """
    names = list(dict.fromkeys(name for combination in level for name in combination))
    at = {name: i for i, name in enumerate(names)}
    hashed = df.select(*[F.xxhash64(F.lit(seed), _quoted(n)).alias(f"{h}{i}") for n, i in at.items() for seed, h in enumerate("xy")])
    entries = []
    for place, combination in enumerate(level):
        values = [F.xxhash64(*[F.col(f"{h}{at[name]}") for name in combination]).alias(h) for h in "xy"]
        entries.append(F.struct(F.lit(place).alias("place"), *values))
    return hashed.select(F.inline(F.array(*entries)))


def _sizes(tables: Mapping[str, DataFrame], usable: Mapping[str, Sequence[str]]) -> DataFrame:
    """(table_name, n, filled): rows, and rows without NULL of each of the columns."""
    parts = [
        tables[name].agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count(_quoted(c)) for c in columns]).cast("array<bigint>").alias("filled"))
        .select(F.lit(name).alias("table_name"), "n", "filled")
        for name, columns in usable.items()
    ]
    return stacked(parts, "table-sizes")


def _repeating(tables: Mapping[str, DataFrame], wanted: Mapping[str, Sequence[Combination]], slices: int = 1) -> set[tuple[str, Combination]]:
    """Combinations with two equal rows, by exact counting: of all values, or of one slice of the values out of `slices`."""
    parts = [_combined(tables[name], level).select(F.lit(name).alias("table_name"), "place", "x", "y") for name, level in wanted.items()]
    if slices > 1:
        parts = [part.where(F.pmod("x", F.lit(slices)) == 0) for part in parts]
    counted = stacked(parts, "key-values").groupBy("table_name", "place", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    return {(row.table_name, wanted[row.table_name][row.place]) for row in counted.where("n > 1").select("table_name", "place").distinct().collect()}


def _without(wanted: Mapping[str, Sequence[Combination]], repeating: set[tuple[str, Combination]]) -> dict[str, list[Combination]]:
    left = {name: [c for c in level if (name, c) not in repeating] for name, level in wanted.items()}
    return {name: level for name, level in left.items() if level}


def unique_combinations(tables: Mapping[str, DataFrame], width: int = 2) -> DataFrame:
    """`table_name, key_columns, n` of the smallest combinations of up to `width` columns in which all rows differ.

    No column of a key holds NULL, and no part of a key is a key itself. Floating numbers and nested values are never keys. Rows are
    compared by 128 bits of their values. A table without rows has no keys; in one of a single row each column is one.
    """
    spark = next(iter(tables.values())).sparkSession
    found: list[tuple[str, list[str], int]] = []
    known: dict[str, list[frozenset[str]]] = {name: [] for name in tables}
    usable = {name: columns for name, df in tables.items() if (columns := _key_columns(df))}
    # One row a table: bounded by the schemas.
    sizes = {row.table_name: row for row in _sizes(tables, usable).collect()} if usable else {}
    # Columns that hold NULL, or nothing, are left out.
    usable = {name: [c for c, filled in zip(columns, sizes[name].filled) if filled == sizes[name].n > 0] for name, columns in usable.items()}
    for size in range(1, width + 1):
        wanted = {
            name: [c for c in combinations(columns, size) if not any(key <= set(c) for key in known[name])] for name, columns in usable.items()
        }
        wanted = {name: level for name, level in wanted.items() if level}
        if not wanted:
            break
        # Two equal rows are in the same slice, so one that holds a pair settles the matter; whoever passes is counted in full.
        likely = _without(wanted, _repeating(tables, wanted, SLICES))
        if not likely:
            continue
        for name, level in _without(likely, _repeating(tables, likely)).items():
            for names in level:
                known[name].append(frozenset(names))
                found.append((name, list(names), sizes[name].n))
    return local_rows(spark, found, "table_name string, key_columns array<string>, n bigint")
