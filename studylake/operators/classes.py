"""Equivalence classes of things that are paired with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.session import materialize


def equivalence_classes(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """`item, class_id` of every item of `pairs`: items that pairs lead to from each other share a class, named by its smallest item.

    Every round each item takes the smallest label among its own and its neighbours', and then the label of that label, so labels
    travel in jumps that double and a chain of n items takes about log n rounds. Labels of neighbours are folded on the map side, so
    an item that a third of all pairs name sends its label along each of them but gathers one per task. Pairs without one of
    their ends tell nothing.
    """
    kind = pairs.schema[one].dataType
    ends = pairs.select(F.col(one).alias("a"), F.col(other).cast(kind).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = materialize(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "class-pairs")
    labels = materialize(both.groupBy(F.col("a").alias("item")).agg(F.least(F.min("b"), F.col("item")).alias("label")), "class-labels")
    while True:
        near = both.join(labels.withColumnRenamed("item", "b"), "b").groupBy(F.col("a").alias("item")).agg(F.min("label").alias("near"))
        taken = labels.join(near, "item").select("item", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        further = labels.select(F.col("item").alias("label"), F.col("label").alias("further"))
        jumped = taken.join(further, "label").select("item", "old", F.least("label", "further").alias("label"))
        rounds = materialize(jumped, "class-labels")
        labels = rounds.select("item", "label")
        if rounds.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "class_id")
