"""Operator 12: web archives, written as WARC records and read back by verified chains of record boundaries.

**Writing.** Records of equal payloads are stored once: the largest id is the response, the others are revisits that name it. Spark's
text writer puts the records down, with the records' closing blank lines as its line separator, so archives go to any store and a
lost task leaves nothing behind.

**Reading.** Version lines (`WARC/1.1`) also occur inside payloads, so a version line is only a candidate. Tasks cut archives at
version lines; from its header each candidate gets the offset of its successor. A record is what can be reached from the start of its
file:

1. *Within a stretch* of a file (16 MB), each candidate is followed to the first offset outside the stretch.
2. *Between stretches*, pointer jumping from offset 0: each round doubles the steps of all pointers and what is known to be reached,
   so a file of s stretches takes log2(s) rounds over a few rows a stretch.
3. Each stretch is walked from the offset at which the chain enters it.

Version lines that are not reached belong to the payload around them, which is put together again. Payloads are joined with these
exceptions only, so a payload is shuffled only if it holds a version line or the exceptions outgrow Spark's broadcast limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studylake.llm.common import free_shuffles, materialize, pick
from studylake.session import scratch_path

VERSION = "WARC/1.1"
LINE = "\r\n"
#: What an archive is cut at. `W` does not recur in it, so no occurrence overlaps another.
MAGIC = VERSION + LINE
BLANK_LINE = LINE + LINE
#: Bytes of an archive whose candidates are followed in one task.
STRETCH = 16 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_STEP = "file string, block long, seq long, at long, next long, ends long, stretch long"
_ARROW_STEP = [("file", pa.string()), *((name, pa.int64()) for name in ("block", "seq", "at", "next", "ends", "stretch"))]
_ARROW_EXITS = pa.schema([*_ARROW_STEP, ("exit", pa.int64())])
_ARROW_MARKED = pa.schema([*_ARROW_STEP, ("reached", pa.bool_())])


def payload_digest(payload: Column) -> Column:
    """SHA-1 in base32, as archives name payloads: four times 40 bits in base 32, in the other alphabet of that base."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header_value(text: Column) -> Column:
    """`text` as the value of a header field: blanks and line breaks escaped, and no version line at its end."""
    for found, written in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), (f"{VERSION}$", "%57" + VERSION[1:])):
        text = F.regexp_replace(text, found, written)
    return text


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_warc(
    pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", compression: str | None = "gzip",
    id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
) -> None:
    """One record per row in archives below `path`, a file per task.

    Of rows with equal payloads of `min_bytes` or more, those of the largest id are responses and hold the payload; the others are
    revisits without one, which refer to it. Rows that repeat the largest id with the payload are responses too. NULL ids are smallest;
    a row without an id has no Page-Id field. NULL payload is empty; a NULL URL leaves its field out. Blanks and line breaks in URLs are
    written as %XX. `compression` None gives archives that several tasks can read at once. An empty table gives an empty archive.
    """
    rows = pick(pages, page_id=id_column, url=url_column, payload=payload_column)
    body = F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))
    rows = rows.select("page_id", "url", body.alias("payload"), F.unhex(F.sha2(body, 256)).alias("key"))
    winners = rows.groupBy("key").agg(F.max("page_id").alias("winner"))
    rows = rows.join(winners, "key")
    size = F.octet_length("payload")
    response = (size < min_bytes) | F.col("page_id").eqNullSafe(F.col("winner"))
    digest = payload_digest(F.col("payload"))
    own, other = _record_id(F.col("page_id"), F.hex("key")), _record_id(F.col("winner"), F.hex("key"))
    rows = rows.select("*", size.alias("size"), response.alias("response"), digest.alias("digest"), own.alias("own"), other.alias("other"))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))

    revisit = ~F.col("response")
    head = F.concat(
        F.lit(MAGIC),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.when(revisit, _record_id(F.col("page_id"), F.concat_ws("|", F.hex("key"), F.lit("revisit")))).otherwise(F.col("own"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", _header_value(F.col("url"))),
        field("Page-Id", _header_value(F.col("page_id").cast("string"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        field("WARC-Refers-To", F.when(revisit, F.col("other"))),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, 0).otherwise(F.col("size")).cast("string")),
        F.lit(LINE),
    )
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    writer = rows.select(F.concat(head, block).alias("value")).write.option("lineSep", BLANK_LINE)
    (writer.option("compression", compression) if compression else writer).text(path)


def header(head: Column, name: str) -> Column:
    """The value of a header field, whatever the case of its name; NULL without one."""
    found = F.regexp_extract(head, rf"(?mi)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between version lines: file, block, seq (order within the block), bytes, head (up to a blank line) and body.

    Without a blank line there is no head and all is body. Written down, so that the numbers stay when a task is repeated.
    """
    cut = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    cut = cut.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value", F.substring_index("value", BLANK_LINE, 1).alias("head"),
    )
    headed = F.octet_length("head") < F.octet_length("value")
    cut = cut.select(
        "file", "block", "seq", F.octet_length("value").cast("long").alias("bytes"), F.when(headed, F.col("head")).alias("head"),
        F.when(headed, F.expr(f"substring(CAST(value AS BINARY), octet_length(head) + {len(BLANK_LINE) + 1})")).otherwise(F.col("value").cast("binary")).alias("body"),
    )
    kept = scratch_path(spark, "warc-pieces")
    cut.write.option("compression", "zstd").parquet(kept)
    return spark.read.schema(cut.schema).parquet(kept)


def _sum_before(value: str | Column, keys: list[str], order: str) -> Column:
    rows = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(rows), F.lit(0).cast("long"))


def candidates(cut: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Version lines as (file, block, seq, at, next, ends, stretch): offset, the successor's offset (NULL without a readable header), and
    where the piece behind it ends. Offsets are sums of the pieces before, first by block, then within it."""
    magic = len(MAGIC)
    declared = header(F.col("head"), "Content-Length").try_cast("long")
    slim = cut.select("file", "block", "seq", "bytes", F.octet_length("head").alias("head_bytes"), declared.alias("declared"))
    span = F.col("bytes") + magic
    blocks = slim.groupBy("file", "block").agg(F.sum(span).alias("span"))
    blocks = blocks.select("file", "block", _sum_before("span", ["file"], "block").alias("base"))
    placed = slim.withColumn("within", _sum_before(span, ["file", "block"], "seq")).join(blocks, ["file", "block"])
    placed = placed.withColumn("at", F.col("base") + F.col("within") - magic).where("at >= 0")
    # Blank line, block, blank line.
    after = F.col("at") + magic + F.col("head_bytes") + F.col("declared") + 2 * len(BLANK_LINE)
    return placed.select(
        "file", "block", "seq", "at", F.when(F.col("declared") >= 0, after).alias("next"), (F.col("at") + magic + F.col("bytes")).alias("ends"),
        F.floor(F.col("at") / stretch).alias("stretch"),
    )


def _successors(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The stretch in order, its offsets, their successors (-1: none) and where those stand in the stretch (-1: not in it)."""
    table = table.sort_by("at")
    at = table.column("at").to_numpy()
    after = table.column("next").fill_null(-1).to_numpy()
    place = np.searchsorted(at, after)
    inside = (after > at) & (place < len(at))
    inside &= at[np.minimum(place, len(at) - 1)] == after
    return table, at, after, np.where(inside, place, -1)


def _followed(table: pa.Table) -> pa.Table:
    """Adds `exit`: the first offset on a candidate's way that is not a candidate of the stretch; -1 where the way ends."""
    table, _, after, place = _successors(table)
    exits = after.copy()
    for i in range(len(exits) - 1, -1, -1):
        if place[i] >= 0:
            exits[i] = exits[place[i]]
    return table.append_column("exit", pa.array(exits)).cast(_ARROW_EXITS)


def _walked(table: pa.Table, entries: pa.Table) -> pa.Table:
    """Adds `reached`: on the way from the offset at which the chain enters the stretch."""
    if not table.num_rows:
        return _ARROW_MARKED.empty_table()
    table, at, _, place = _successors(table.drop(["exit"]))
    reached = np.zeros(len(at), bool)
    for entry in entries.column("at").to_pylist():
        i = int(np.searchsorted(at, entry))
        while i >= 0 and not reached[i]:
            reached[i] = True
            i = int(place[i])
    return table.append_column("reached", pa.array(reached)).cast(_ARROW_MARKED)


def entries(exits: DataFrame) -> tuple[DataFrame, int]:
    """Offsets at which the chain from offset 0 enters a stretch, by pointer jumping, and the rounds it took."""
    start = F.col("at") == 0
    targets = exits.select("file", F.col("exit").alias("at")).where("at >= 0").distinct()
    nodes = exits.join(targets.withColumn("target", F.lit(True)), ["file", "at"], "left").where(start | F.col("target"))
    jump = materialize(nodes.select("file", "at", F.col("exit").alias("to")), "warc-jumps")
    known = jump.select("file", "at")
    reached, rounds = known.where(start), 0
    # Pointers that lead out of the file go at once.
    jump = materialize(jump.join(known.withColumnRenamed("at", "to"), ["file", "to"], "left_semi").select("file", "at", "to"), "warc-jumps")
    while not jump.isEmpty():
        rounds += 1
        further = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = materialize(reached.unionByName(further).distinct(), "warc-reached")
        on = jump.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = materialize(jump.join(on, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")), "warc-jumps")
    return reached, rounds


def boundaries(cut: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Candidates with `reached`: true for records, false for version lines inside payloads or behind a break of the chain."""
    steps = candidates(cut, stretch)
    exits = materialize(steps.groupBy("file", "stretch").applyInArrow(_followed, f"{_STEP}, exit long"), "warc-exits")
    found, _ = entries(exits)
    entered = found.withColumn("stretch", F.floor(F.col("at") / stretch))
    marked = exits.groupBy("file", "stretch").cogroup(entered.groupBy("file", "stretch")).applyInArrow(_walked, f"{_STEP}, reached boolean")
    return materialize(marked, "warc-boundaries")


def verified(cut: DataFrame, marked: DataFrame) -> DataFrame:
    """(file, n_bytes, n_candidates, n_records, n_rejected, complete): complete if the chain ends where the file does."""
    reached = F.when(F.col("reached"), 1).otherwise(0)
    sizes = cut.groupBy("file").agg((F.sum(F.col("bytes") + len(MAGIC)) - len(MAGIC)).alias("n_bytes"))
    chains = marked.groupBy("file").agg(
        F.count("*").alias("n_candidates"), F.sum(reached).alias("n_records"), F.max(F.when(F.col("reached"), F.col("next"))).alias("end")
    )
    none = F.lit(0).cast("long")
    return sizes.join(chains, "file", "left").select(
        "file", "n_bytes", F.coalesce("n_candidates", none).alias("n_candidates"), F.coalesce("n_records", none).alias("n_records"),
        (F.coalesce("n_candidates", none) - F.coalesce("n_records", none)).alias("n_rejected"),
        (F.coalesce("end", none) == F.col("n_bytes")).alias("complete"),
    )


def verify_warc(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    """The chain of each archive below `path`: see `verified`."""
    cut = pieces(spark, path)
    return verified(cut, boundaries(cut, stretch))


def _glued(cut: DataFrame, parts: DataFrame) -> DataFrame:
    """Records whose payloads hold version lines, from their pieces in order."""
    whole = F.concat(F.coalesce(F.concat(F.col("head"), F.lit(BLANK_LINE)), F.lit("")), F.col("body").cast("string"))
    opening = F.col("at") == F.col("owner")
    rows = cut.join(parts, ["file", "block", "seq"]).select(
        "file", "owner", "at", F.when(opening, F.col("head")).alias("head"), F.when(opening, F.col("body").cast("string")).otherwise(whole).alias("text")
    )
    records = rows.groupBy("file", "owner").agg(F.max("head").alias("head"), F.sort_array(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return records.select("file", "head", F.array_join(F.col("parts.text"), MAGIC).cast("binary").alias("body"))


def read_warc(spark: SparkSession, path: str, strict: bool = True, stretch: int = STRETCH) -> DataFrame:
    """The records of the archives below `path`, plain or gzipped.

    Returns a row per record: file, record_type, record_id, refers_to, target_uri, page_id, digest (of the payload, as the header says),
    head (all header fields) and payload (the block as binary; none for a revisit). Fields a record lacks are NULL. A chain that breaks
    before the end of its file stops the job if `strict`; otherwise the file's records up to there are returned. An empty archive
    has no records. The payload of a record is one cell.
    """
    cut = pieces(spark, path)
    marked = boundaries(cut, stretch)
    broken = verified(cut, marked).where("NOT complete").select("file").limit(3).collect() if strict else []
    if broken:
        raise ValueError(f"archives whose records do not lead to their end: {[row.file for row in broken]}")
    open_ended = F.col("reached") & (F.col("next") > F.col("ends"))
    odd = marked.where(~F.col("reached") | open_ended | F.col("next").isNull())
    order = Window.partitionBy("file").orderBy("at")
    owner = F.last(F.when(open_ended, F.struct("at", "next")), ignorenulls=True).over(order)
    parts = odd.withColumn("record", owner).where(F.col("at") < F.col("record.next"))
    parts = materialize(parts.select("file", "block", "seq", "at", F.col("record.at").alias("owner")), "warc-parts")
    # What is before a file's first version line is no record either; a sound archive has nothing there.
    first = cut.select("file", "block", "seq").where("block = 0").groupBy("file", "block").agg(F.min("seq").alias("seq"))
    others = materialize(odd.select("file", "block", "seq").unionByName(first), "warc-others")
    records = cut.join(others, ["file", "block", "seq"], "left_anti").select("file", "head", "body")
    records = records.unionByName(_glued(cut, parts))
    declared = header(F.col("head"), "Content-Length").try_cast("int")
    head = F.col("head")
    digest = F.regexp_replace(header(head, "WARC-Payload-Digest"), "^sha1:", "")
    return records.select(
        "file", header(head, "WARC-Type").alias("record_type"), header(head, "WARC-Record-ID").alias("record_id"),
        header(head, "WARC-Refers-To").alias("refers_to"), header(head, "WARC-Target-URI").alias("target_uri"),
        header(head, "Page-Id").alias("page_id"), digest.alias("digest"), "head", F.substring(F.col("body"), F.lit(1), declared).alias("payload"),
    )


def page_records(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to; revisits have the payload figures of their response.

    Only figures are joined, never payloads. A revisit whose response is in none of the archives has NULL figures.
    """
    payload = F.col("payload")
    facts = records.select(
        "page_id", "record_type", "record_id", "refers_to", F.octet_length(payload).cast("long").alias("payload_bytes"),
        payload_digest(payload).alias("payload_digest"),
    )
    facts = materialize(facts, "warc-facts")
    revisit = F.col("record_type") == "revisit"
    own = facts.where(~revisit)
    # Responses of one id hold the same page and payload.
    named = own.groupBy("record_id").agg(*(F.max(c).alias(c) for c in ("page_id", "payload_bytes", "payload_digest")))
    named = named.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("response"), "payload_bytes", "payload_digest")
    again = facts.where(revisit).select("page_id", "record_type", "refers_to").join(named, "refers_to", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return own.select(*columns, F.lit(None).cast("string").alias("refers_to")).unionByName(again.select(*columns, F.col("response").alias("refers_to")))


def archive_pages(
    pages: DataFrame, min_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
    compression: str | None = "gzip",
) -> DataFrame:
    """Writes `pages` as archives in the shared scratch folder and reads them back: see `write_warc`, `read_warc`, `page_records`.

    page_id and refers_to have the type of the given ids.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, min_bytes, compression=compression, id_column=id_column, url_column=url_column, payload_column=payload_column)
    free_shuffles(spark)
    kind = pick(pages, page_id=id_column).schema["page_id"].dataType
    found = page_records(read_warc(spark, path))
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
