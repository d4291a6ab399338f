"""Bounded samples of labelled rows for fitting, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake.session import local_rows

#: Rows a classifier is fitted on, about; never more than twice as many.
SAMPLE_ROWS = 4000
#: Rows of each label, at least, where the labels themselves are sampled (`training_texts`).
LABEL_ROWS = 100
#: Hash values that samples by label are drawn from: fine enough for a small share of very many rows.
HASHES = 1 << 40
#: Longer texts are not taken into a sample (they are scored whole like any other).
SAMPLE_TEXT_BYTES = 32 * 1024


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _thinned(rows: DataFrame, key: list[str], limit: int) -> DataFrame:
    """About `limit` of the rows, the same ones every time, chosen by a hash."""
    total = rows.count()
    if total <= limit:
        return rows.limit(2 * limit)
    return rows.where(F.pmod(F.xxhash64(*key, F.lit(17)), F.lit(1 << 20)) < int(limit / total * (1 << 20))).limit(2 * limit)


def training_texts(docs: DataFrame, label: str, limit: int = SAMPLE_ROWS) -> list[tuple[str, object]]:
    """(text, label) of a sample of rows that are not held out, have a label and a text of bounded length.

    Each label gets a sample of its own, about `limit` rows shared evenly among the labels and at least `LABEL_ROWS` each: a label of
    few rows has all of them, whatever the size of the table. Labels are few; one row for each goes to the driver and back.
    `docs` has doc_id, text and the label column.
    """
    usable = docs.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull() & (F.octet_length("text") <= SAMPLE_TEXT_BYTES))
    usable = usable.select("doc_id", "text", F.col(label).alias("label"))
    totals = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return []
    each = max(LABEL_ROWS, limit // len(totals))
    shares = [(name, min(HASHES, -(-each * HASHES // n))) for name, n in totals.items()]
    fields = T.StructType([T.StructField("label", usable.schema["label"].dataType), T.StructField("share", T.LongType())])
    kept = local_rows(docs.sparkSession, shares, fields)
    hashed = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(HASHES))
    rows = usable.join(F.broadcast(kept), "label").where(hashed < F.col("share")).select("text", "label")
    return sorted(((r["text"], r["label"]) for r in rows.limit(2 * each * len(totals)).collect()), key=lambda r: (r[0], str(r[1])))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """As `training_texts`, with labels (doc_id, label) from another table: the sampled ids are broadcast to the texts.

    A doc_id with labels that differ, or of several texts, gives a row for each pair.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = _thinned(usable.select("doc_id", label).distinct(), ["doc_id"], limit)
    texts = docs.where(F.octet_length("text") <= SAMPLE_TEXT_BYTES).select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", label).limit(2 * limit).collect()
    return sorted(((r["text"], int(r[label])) for r in rows))
