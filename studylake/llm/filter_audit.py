"""Operator 11: what each filter removes in each order of the filters, by a recursive query over mask cells.

A document is reduced to a mask with a bit for each filter that it fails. Documents are counted per (part, mask): at most 2^f cells a
part, however many documents. A recursive common table expression then extends every prefix of an order by each letter it does not
hold yet, joins the part's cells, carries the bits applied so far, and gives that step's figures; no document is read again.

Prefixes are shared: five filters have 325 of them and 120 orders of 5 steps, so a step is worked out once for all orders that
begin alike.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.llm.common import materialize, pick

#: Blanks between words; a text is cut at runs of them.
BLANKS = r"[\x20\x09-\x0D]+"
#: Letter of the filter that fails documents whose text is that of a row with a smaller id.
COPY = "E"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 50


def _few_distinct_words(text: Column, words: Column) -> Column:
    return F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 65


def _capitals(text: Column, words: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 5


def _odd_signs(text: Column, words: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


Filter = Callable[[Column, Column], Column]
#: When a text fails, from the text and its words; filters that look at one text at a time.
FILTERS: dict[str, Filter] = {"A": _few_words, "B": _few_distinct_words, "C": _capitals, "D": _odd_signs}


def masks(
    docs: DataFrame, filters: Mapping[str, Filter] = FILTERS, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source"
) -> DataFrame:
    """Rows (doc_id, part, mask, text_key): bit i of the mask is set if the row fails filter i; text_key knows the text."""
    rows = pick(docs, doc_id=id_column, text=text_column, part=part_column)
    text = F.coalesce("text", F.lit(""))
    rows = rows.select("doc_id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), text.alias("text"), words_of(text).alias("words"))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    return rows.select("doc_id", "part", sum(bits, F.lit(0)).alias("mask"), F.unhex(F.sha2("text", 256)).alias("text_key"))


def mask_cells(rows: DataFrame, labels: DataFrame, copy_bit: int) -> DataFrame:
    """(part, mask, n, good, toxic) with `copy_bit` added to the mask of rows whose text has a smaller id.

    Rows of equal text are folded before they meet, so a text that a third of all rows hold arrives as one row for each part, mask
    and label; only the smallest id of a text and how often it occurs travel with them.
    """
    marked = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id IS NOT NULL")
    is_one = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0))
    marked = marked.groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    none = F.lit(0).alias("good"), F.lit(0).alias("toxic")
    known = rows.where("doc_id IS NOT NULL").join(marked, "doc_id", "left").fillna(0, ["good", "toxic"])
    columns = ["text_key", "part", "mask", "good", "toxic"]
    rows = known.select("doc_id", *columns).unionByName(rows.where("doc_id IS NULL").select("*", *none).select("doc_id", *columns))
    rows = materialize(rows, "audit-rows")
    named = rows.groupBy(*columns, "doc_id").agg(F.count("*").alias("n"))
    has_id = F.col("doc_id").isNotNull()
    groups = named.groupBy(*columns).agg(
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("least"), F.sum("n").alias("n"), F.sum(F.when(~has_id, F.col("n")).otherwise(0)).alias("unnamed"),
    )
    smallest = F.min("least.doc_id").over(Window.partitionBy("text_key"))
    first = F.col("unnamed") + F.when(F.col("least.doc_id") == smallest, F.col("least.n")).otherwise(0)
    split = groups.select("part", "mask", "good", "toxic", "n", first.alias("first"))
    sides = F.array(
        F.struct(F.col("mask"), F.col("first").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(copy_bit)).alias("mask"), (F.col("n") - F.col("first")).alias("n")),
    )
    cells = split.select("part", "good", "toxic", F.explode(sides).alias("side")).select("part", "good", "toxic", "side.*").where("n > 0")
    of = lambda name: F.sum(F.col("n") * F.col(name)).alias(name)
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


_FOLD = "aggregate(filter(c.cells, x -> {where}), 0L, (a, x) -> a + x.{count})"
_FRESH = "x.mask & s.applied = 0"
_STEPS = """
WITH RECURSIVE steps (part, prefix, applied, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
  UNION ALL
  SELECT s.part, concat(s.prefix, s.letter), s.applied | s.bit, s.step + 1, s.letter,
    {kept}, {removed}, {redundant}, {unique}, {good}, {toxic}
  FROM (
    SELECT part, prefix, applied, step, unused AS letter, shiftleft(1, instr('{letters}', unused) - 1) AS bit
    FROM steps LATERAL VIEW explode(filter(split('{letters}', ''), x -> instr(prefix, x) = 0)) u AS unused
  ) s JOIN {{cells}} c ON s.part = c.part
)
SELECT * FROM steps WHERE step > 0 LIMIT ALL"""


def prefix_steps(cells: DataFrame, letters: str) -> DataFrame:
    """One row per part and prefix of an order: the figures of the prefix's last step. A level of the recursion per step."""
    folded = {
        "kept": _FOLD.format(where="x.mask & (s.applied | s.bit) = 0", count="n"),
        "removed": _FOLD.format(where=f"x.mask & s.bit <> 0 AND {_FRESH}", count="n"),
        "redundant": _FOLD.format(where="x.mask & s.bit <> 0 AND x.mask & s.applied <> 0", count="n"),
        "unique": _FOLD.format(where="x.mask = s.bit", count="n"),
        "good": _FOLD.format(where=f"x.mask & s.bit <> 0 AND {_FRESH}", count="good"),
        "toxic": _FOLD.format(where=f"x.mask & s.bit <> 0 AND {_FRESH}", count="toxic"),
    }
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    parts = materialize(parts, "mask-cells")
    return parts.sparkSession.sql(_STEPS.format(letters=letters, **folded), cells=parts)


def interactions(cells: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, …) for every order of `letters` from cells (part, mask, n, good, toxic); bit i is letter i.

    kept: documents left after the step; removed: those it takes; redundant: those that fail its filter and were gone; unique_fails:
    those that fail its filter alone; good_lost, toxic_lost: labelled ones it takes; shapley: what its filter removes, summed over all
    orders.
    """
    size = len(letters)
    steps = materialize(prefix_steps(cells, letters), "filter-steps")
    orders_from = F.element_at(F.array(*(F.lit(factorial(size - i - 1)).cast("long") for i in range(size))), F.col("step"))
    shapley = F.sum(F.col("removed") * orders_from).over(Window.partitionBy("part", "letter"))
    steps = steps.withColumn("shapley", shapley)
    orders = steps.where(F.col("step") == size).select(F.col("prefix").alias("filter_order")).distinct()
    places = F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step")
    orders = orders.select("filter_order", places).select("filter_order", F.expr("substring(filter_order, 1, step)").alias("prefix"))
    # size! * size rows, whatever the input.
    return steps.join(F.broadcast(orders), "prefix").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def filter_audit(
    docs: DataFrame, labels: DataFrame, filters: Mapping[str, Filter] = FILTERS, id_column: str = "doc_id", text_column: str = "text",
    part_column: str = "source",
) -> DataFrame:
    """Interactions of `filters` and of the copy filter `E` over whole texts, per part.

    Returns one row per part, filter_order and step, zeros included; see `interactions`. NULL text is empty, a NULL part is the part of
    empty name. A row fails `E` if its text is also that of a smaller doc_id; rows that repeat with one id are not smaller than each
    other, and a row of NULL id neither fails nor makes others fail. A document is good (toxic) if any of its labels says so; rows
    without a label are neither. An empty table has no parts and gives no rows. Other columns are ignored, whatever their names.
    """
    rows = masks(docs, filters, id_column, text_column, part_column)
    cells = mask_cells(rows, labels, 1 << len(filters))
    return interactions(cells, "".join(filters) + COPY)
