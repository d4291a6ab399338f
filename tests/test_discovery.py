"""Keys and references in data, against reading every pair of columns."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from studylake.operators import discovery as disc


def random_tables(rng, n):
    """Tables of integers and texts whose columns often hold each other's values."""
    tables = {}
    for t in range(n):
        pool = rng.sample(range(12), rng.randint(1, 6))
        texts = [None, "", "a", "b", "x" * 64, "x" * 65, "y" * 500, "5"]
        rows = [
            (rng.choice(pool), rng.choice([*pool, None]), rng.choice(texts[: rng.randint(1, 8)]), None, rng.random())
            for _ in range(rng.choice([0, 1, 3, 20]))
        ]
        tables[f"t{t}"] = rows
    return tables


SCHEMA = "a int, b bigint, `c d` string, empty string, number double"
NAMES = {"integer": {"a": 0, "b": 1}, "text": {"c d": 2, "empty": 3}}


def plainly(tables):
    held = {}
    for name, rows in tables.items():
        for kind, columns in NAMES.items():
            for column, i in columns.items():
                held[name, column] = (kind, {r[i] for r in rows if r[i] is not None})
    return {
        (*one, *two) for one, (kind, values) in held.items() for two, (other, more) in held.items()
        if one != two and kind == other and values and values <= more
    }


@pytest.mark.parametrize("n", [1, 6, 40])
def test_references_equal_every_pair(frame, n):
    """Forty tables are more than one batch, and more columns than one number has bits."""
    tables = random_tables(random.Random(n), n)
    frames = {name: frame(rows, SCHEMA) for name, rows in tables.items()}
    found = disc.inclusion_dependencies(frames).collect()
    assert {tuple(r) for r in found} == plainly(tables)
    assert len(found) == len(plainly(tables))


def test_no_columns_to_compare(frame):
    assert disc.inclusion_dependencies({"t": frame([(1.5,)], "x double")}).collect() == []


def keys_plainly(rows, names, width):
    found = []
    for size in range(1, width + 1):
        for chosen in combinations(range(len(names)), size):
            if any(set(k) <= set(chosen) for k in found) or not rows:
                continue
            values = [tuple(r[i] for i in chosen) for r in rows]
            if len(set(values)) == len(rows) and not any(None in v for v in values):
                found.append(chosen)
    return {tuple(names[i] for i in chosen) for chosen in found}


def test_keys_equal_brute_force(frame):
    rng = random.Random(4)
    names = ["a", "b", "c", "d", "e"]
    tables = {"none": [], "one": [(1, 2, 3, None, "x")], "three": [(i // 9, i // 3 % 3, i % 3, 0, "x") for i in range(27)]}
    for t in range(6):
        n = rng.choice([4, 30, 200])
        tables[f"t{t}"] = [
            (i // 10, i % 10, rng.randrange(3), rng.choice([i, i, None]) if t % 2 else i // 2, f"{rng.randrange(n * n if t > 3 else 4)}") for i in range(n)
        ]
    frames = {name: frame(rows, "a int, b bigint, c int, d int, e string").withColumn("x", F.rand()) for name, rows in tables.items()}
    found = disc.unique_combinations(frames, width=3).collect()
    got = {name: {tuple(r.key_columns) for r in found if r.table_name == name} for name in tables}
    assert got == {name: keys_plainly(rows, names, 3) for name, rows in tables.items()}
    assert all(r.n == len(tables[r.table_name]) for r in found)
    assert any(len(r.key_columns) == 3 for r in found) and any(len(r.key_columns) == 2 for r in found)


def test_nearly_a_key_is_none(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") == 7, 8).otherwise(F.col("id")).alias("nearly"), (F.col("id") % 5).alias("five"))
    found = {tuple(r.key_columns) for r in disc.unique_combinations({"t": rows}).collect()}
    assert found == {("id",), ("nearly", "five")}


def test_what_repeats_in_a_slice_is_not_counted_in_full(spark, monkeypatch):
    """A column with one repeat in twenty values passes for a key by its approximate count, but not in a slice of its values."""
    rows = spark.range(20_000).select("id", (F.col("id") % 19_000).alias("often"), F.lit(1).alias("one"), F.lit(None).cast("int").alias("none"))
    counted, repeating = [], disc._repeating

    def recorded(tables, wanted, slices=1):
        if slices == 1:
            counted.extend(c for level in wanted.values() for c in level)
        return repeating(tables, wanted, slices)

    monkeypatch.setattr(disc, "_repeating", recorded)
    assert [tuple(r.key_columns) for r in disc.unique_combinations({"t": rows, "empty": rows.limit(0)}).collect()] == [("id",)]
    assert ("id",) in counted and ("often",) not in counted


def test_many_tables_go_in_batches(spark):
    tables = {f"t{i}": spark.range(i, i + 3).select(F.col("id").cast("int").alias("k")) for i in range(70)}
    frame = disc.stacked([df.withColumn("t", F.lit(name)) for name, df in tables.items()], "stacked")
    assert frame.count() == 210 and "Union" not in frame._jdf.queryExecution().optimizedPlan().toString()
