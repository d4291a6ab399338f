"""Operator 6: mix sources to target weights by entropy balancing.

Among all ways to weigh documents so that each source gives its target of words, entropy balancing takes the one closest to
one copy of everything (least relative entropy, words as the unit). Its dual is convex with one multiplier for each source;
the solution is exponentially tilted: a document is taken exp(multiplier) times. Newton steps run on a table with a row per
source, which holds all that gradient and curvature need: the words of its documents. Rates are then rounded into whole copies.

Targets: sources in code-point order, NULL last, weigh 5, 2, 1 and again; together they share all words; none gets more than
`most` times its own words, and what is cut off goes to the others by weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.llm.common import by_place, materialize, partitions, pick

WEIGHTS = (5, 2, 1)
MOST = 3
#: Relative error of a source's words at which Newton's steps end.
PRECISION = 1e-14
#: Words are rounded half up, whatever the last bits of a rate.
HALF = 0.5 + 1e-6
#: Buckets that a source's documents are drawn into.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draw(doc_id: Column, text: Column) -> Column:
    """A number of 32 bits that depends on the id and the text only."""
    empty = F.lit("")
    own = F.concat_ws("|", F.coalesce(doc_id.cast("string"), empty), F.md5(F.coalesce(text, empty).cast("binary")))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, 8), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with `place` from 0 in code-point order, NULL last; ordered in ranges, not in one task."""
    parts = sources.repartitionByRange(partitions(sources.sparkSession), F.col("source").asc_nulls_last())
    parts = materialize(parts.withColumn("part", F.spark_partition_id()), "source-ranges")
    # One row for each range.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.join(shift, "part").withColumn("place", own + F.col("shift") - 1).drop("part", "shift")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with `target`; each round caps the sources whose share is above their limit."""
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = materialize(_ranked(sources).withColumn("weight", weight).drop("place"), "sources")
    limit = F.col("source_size") * most
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > limit
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(over, limit)), F.lit(0)).alias("cut"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open"), F.count(F.when(over, 1)).alias("capped"),
        ).first()
        if row["capped"] == capped or not row["open"]:
            break
        capped, level = row["capped"], (row["all"] - row["cut"]) / row["open"]
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), limit.cast("double"))).drop("weight")


def balance(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) with `rate` = exp(multiplier), by Newton's method on the dual, all sources at once.

    The dual of a source is words * exp(m) - target * m; a step adds target / (words * exp(m)) - 1, at least -2 and at most 2.
    Sources without words or without a target get rate 0.
    """
    state = materialize(sources.withColumn("m", F.lit(0.0)), "multipliers")
    active = (F.col("source_size") > 0) & (F.col("target") > 0)
    given = F.col("source_size") * F.exp("m")
    last = None
    while True:
        step = F.when(active, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("target") / given - 1))).otherwise(0.0)
        state = materialize(state.withColumn("m", F.col("m") + step), "multipliers")
        error = state.where(active).agg(F.max(F.abs(given / F.col("target") - 1))).first()[0]
        if error is None or error <= PRECISION:
            break
        # At the last bits a step may only move between neighbours.
        if error <= 64 * PRECISION and error == last:
            break
        last = error
    return state.withColumn("rate", F.when(active, F.exp("m")).otherwise(0.0)).drop("m")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_column: str = "doc_id", text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """How many words a mix of the sources takes of each document.

    Returns a row per input row: doc_id, size (words; NULL text 0), source_size, target (its source's), rate, taken and copies.
    A source's rate becomes whole copies: all documents are taken as often as the whole part of the rate says, and as many of them
    once more as the rest of the target has room for, in an order drawn from id and text, so reruns agree. The last of those
    is taken in part, its beginning, so that a source gives its target to a word; no other document is cut. taken is at most
    `most` * size. Rows that repeat are taken one by one. Sources without words have target 0. No rows give no rows; other columns
    are ignored.
    """
    rows = pick(docs, doc_id=id_column, text=text_column, source=source_column)
    sized = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), _draw(F.col("doc_id"), F.col("text")).alias("draw"))
    sized = materialize(sized, "sizes")
    return _taken(sized, sized, _rates(sized, weights, most)).drop("source", "draw")


def _rates(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    sources = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    return materialize(balance(targets(sources, weights, most)), "rates")


def _copies(sized: DataFrame, rates: DataFrame) -> DataFrame:
    """rates with `base`, the copies of all documents of a source, and where the documents taken once more end: those of buckets before
    `split`, and `left` words of those in it."""
    wanted = F.floor(F.col("rate") * F.col("source_size") + HALF)
    base = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long")
    rates = rates.withColumn("base", base).withColumn("rest", (wanted - F.col("base") * F.col("source_size")).cast("long"))
    words = sized.groupBy("source", _bucket().alias("bucket")).agg(F.sum("size").alias("words"))
    # At most as many rows a source as there are buckets.
    up_to = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    words = words.withColumn("up_to", up_to).withColumnRenamed("source", "of")
    joined = words.join(rates, words["of"].eqNullSafe(rates["source"]))
    beyond = joined.where(F.col("up_to") > F.col("rest"))
    split = beyond.groupBy("source").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("up_to") + F.col("words")).alias("left"))).alias("at"))
    split = split.select(F.col("source").alias("of"), F.col("at.bucket").alias("split"), F.col("at.left").alias("left"))
    found = rates.join(split, rates["source"].eqNullSafe(split["of"]), "left").drop("of", "rest")
    return materialize(found.fillna({"split": BUCKETS, "left": 0}), "copies")


def _bucket() -> Column:
    return F.floor(F.col("draw") / F.lit((1 << 32) // BUCKETS)).cast("int")


def _taken(rows: DataFrame, sized: DataFrame, rates: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, draw, …) with their source's columns, `taken` and `copies`; `sized` are their sizes and draws.

    Only the documents of a source's split bucket, one in `BUCKETS`, have to be put in order.
    """
    rates = _copies(sized, rates).withColumnRenamed("source", "of")
    out = rows.join(rates, rows["source"].eqNullSafe(rates["of"])).drop("of")
    bucket = _bucket()
    before = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    apart = out.where(bucket != F.col("split")).withColumn("more", F.when(bucket < F.col("split"), F.col("size")).otherwise(0))
    room = F.col("left") - F.coalesce(F.sum("size").over(before), F.lit(0))
    within = out.where(bucket == F.col("split")).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), room)))
    out = apart.unionByName(within).withColumn("taken", (F.col("base") * F.col("size") + F.col("more")).cast("long"))
    copies = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0).cast("long"))
    return out.withColumn("copies", copies).drop("base", "split", "left", "more")


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_column: str = "doc_id", text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """`docs` that the mix takes words of, with mix_size, mix_target, mix_taken and mix_copies beside their columns; see `mix`."""
    plain, places = by_place(docs)
    text = plain[places[text_column]]
    boxed = plain.select(
        F.struct("*").alias("box"), plain[places[id_column]].alias("doc_id"), plain[places[source_column]].alias("source"),
        word_count(text).alias("size"), _draw(plain[places[id_column]], text).alias("draw"),
    )
    sized = materialize(boxed.select("source", "size", "draw"), "sizes")
    out = _taken(boxed, sized, _rates(sized, weights, most)).where("taken > 0")
    return out.select("box.*", "size", "target", "taken", "copies").toDF(
        *docs.columns, "mix_size", "mix_target", "mix_taken", "mix_copies"
    )
