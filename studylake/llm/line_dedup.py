"""Operator 2: lines that recur on a site, by their frequency relative to the site.

A line is boilerplate if more than `ratio` of the site's pages contain it, and at least `least` pages do. Pages are counted
per (site, line) with partial sums, so neither a site nor a line that holds a third of all rows meets in one task. A site has
fewer than (distinct lines of an average page) / `ratio` boilerplate lines, however many pages it has; that list is what pages
are joined with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import by_place, materialize
from studylake.llm.mixing import word_count

#: Boilerplate lines of all sites up to which the lists are broadcast (some 50 bytes each); beyond that they are joined by shuffle.
BROADCAST_LINES = 100_000
#: Words of a line that no two texts have by chance; the share of a source's texts, and how many, from which it is boilerplate; the
#: share of a text's words up to which its recurring lines are not the text itself.
SENTENCE, SENTENCE_RATIO, SENTENCE_LEAST, SENTENCE_SHARE = 5, 0.01, 20, 0.5
#: Text between tags is a line; scripts, styles and comments are breaks as a whole.
HTML_BREAK = r"(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|\n"


def host_of(url: Column) -> Column:
    """The host of a URL as it is written; empty without one."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def _key(line: Column) -> Column:
    """128 bits of fingerprint."""
    return F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit(1), line).alias("y"))


def boilerplate(rows: DataFrame, ratio: float, least: int) -> DataFrame:
    """(site, keys) of sites with boilerplate, from rows (site, lines)."""
    totals = rows.groupBy("site").agg(F.count("*").alias("pages"))
    lines = rows.select("site", F.explode(F.array_distinct(F.transform("lines", _key))).alias("key"))
    counts = lines.groupBy("site", "key").agg(F.count("*").alias("holding")).where(F.col("holding") >= least)
    counts, totals = materialize(counts, "line-counts"), materialize(totals, "site-totals")
    often = counts.join(totals, "site").where(F.col("holding") > F.col("pages") * ratio)
    return materialize(often.groupBy("site").agg(F.collect_list("key").alias("keys")), "boilerplate")


def boilerplate_of_texts(rows: DataFrame, ratio: float, least: int) -> DataFrame:
    """As `boilerplate`, of lines that also pass `ratio` and `least` where a site's rows of the same lines count once; and sentences.

    A line of `SENTENCE` words or more is boilerplate already if more than `SENTENCE_RATIO` of the site's different texts hold it,
    and at least `SENTENCE_LEAST` do, whose words are not mostly those of such lines: near copies share nearly all their lines.
    """
    keys = F.sort_array(F.array_distinct(F.transform("lines", lambda x: F.struct(_key(x).alias("key"), word_count(x).alias("words")))))
    texts = materialize(rows.groupBy("site", keys.alias("keys")).agg(F.count("*").alias("n")), "line-sets")
    totals = texts.groupBy("site").agg(F.count("*").alias("texts"), F.sum("n").alias("pages"))
    lines = texts.select("site", F.explode("keys").alias("line"), "n").select("site", "line.*", "n")
    counts = lines.groupBy("site", "key", "words").agg(F.count("*").alias("among"), F.sum("n").alias("holding")).where(F.col("among") >= least)
    counts, totals = materialize(counts, "line-counts"), materialize(totals, "site-totals")
    often = (F.col("holding") > F.col("pages") * ratio) & (F.col("among") > F.col("texts") * ratio)
    many = (F.col("among") >= SENTENCE_LEAST) & (F.col("among") > F.col("texts") * SENTENCE_RATIO)
    recurring = counts.join(totals, "site").select("site", "key", often.alias("often"), ((F.col("words") >= SENTENCE) & many).alias("many"), "texts")
    recurring = materialize(recurring.where("often OR many"), "recurring-lines")
    # The sentences again, counted where they are not most of the text.
    lists = recurring.groupBy("site").agg(F.collect_list("key").alias("recurring"))
    lists = F.broadcast(lists) if recurring.count() <= BROADCAST_LINES else lists
    words = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x["words"])
    held = texts.join(lists, "site").select("site", "keys", F.filter("keys", lambda x: F.array_contains("recurring", x["key"])).alias("held"))
    held = held.where(words(F.col("held")) <= words(F.col("keys")) * SENTENCE_SHARE)
    held = held.select("site", F.explode("held.key").alias("key")).groupBy("site", "key").agg(F.count("*").alias("among"))
    found = recurring.join(held, ["site", "key"], "left").where(F.col("often") | (F.col("many") & many))
    return materialize(found.groupBy("site").agg(F.collect_list("key").alias("keys")), "boilerplate")


def without_boilerplate(rows: DataFrame, ratio: float, least: int, find=boilerplate) -> DataFrame:
    """rows (site, lines, …) with `kept`, the lines left in order."""
    found = find(rows.select("site", F.filter("lines", lambda x: F.trim(x) != "").alias("lines")), ratio, least)
    size = found.agg(F.sum(F.size("keys"))).first()[0] or 0
    joined = rows.join(F.broadcast(found) if size <= BROADCAST_LINES else found, "site", "left")
    keys = F.col("keys")
    left = F.filter("lines", lambda x: ~F.array_contains(keys, _key(x)))
    return joined.withColumn("kept", F.when(keys.isNull(), F.col("lines")).otherwise(left)).drop("keys")


def page_lines(
    pages: DataFrame, ratio: float = 0.3, least: int = 3, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """The text lines of web pages without the lines that recur on their host.

    Returns a row per input row: page_id, host, n_lines, n_dropped and text (kept lines, joined by line breaks). Lines are the
    non-blank texts between tags, without blanks around them. A line counts once for each row that has it, so repeated rows
    count as pages of their own. NULL or empty HTML has no lines; pages without a URL are one host of empty name. No rows
    give no rows; other columns are ignored.
    """
    plain, places = by_place(pages)
    lines = F.split(F.coalesce(plain[places[html_column]], F.lit("")), HTML_BREAK)
    rows = plain.select(
        plain[places[id_column]].alias("page_id"), host_of(plain[places[url_column]]).alias("site"),
        F.array_remove(F.transform(lines, lambda x: F.trim(x)), "").alias("lines"),
    )
    out = without_boilerplate(rows, ratio, least)
    return out.select(
        "page_id", F.col("site").alias("host"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"),
    )


def drop_lines(
    docs: DataFrame, ratio: float = 0.3, least: int = 3, site_column: str = "source", text_column: str = "text", size_column: str = "n_chars"
) -> DataFrame:
    """`docs` with the lines taken out of their texts that recur in their source; columns as before, of whatever names.

    A line must be in more than `ratio` of the source's rows and in more than `ratio`, and at least `least`, of its different
    texts. Texts of the same lines, in any order and number, are one, so copies alone make no line boilerplate. Blank lines
    stay and are never boilerplate. `size_column`, where there is one, becomes the length of the new text. A text that loses
    lines and has only blank ones left goes, with its row; NULL and empty texts stay as they are. Rows without a source are
    one source.
    """
    plain, places = by_place(docs)
    text = plain[places[text_column]]
    rows = plain.select(
        F.struct("*").alias("box"), F.coalesce(plain[places[site_column]], F.lit("\0")).alias("site"),
        F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"),
    )
    out = without_boilerplate(rows, ratio, least, boilerplate_of_texts)
    changed = F.size("kept") < F.size("lines")
    out = out.where(~changed | F.exists("kept", lambda x: F.trim(x) != ""))
    old = F.col(f"box.{places[text_column]}")
    new = F.when(changed, F.array_join("kept", "\n")).otherwise(old)
    columns = []
    for i, name in enumerate(docs.columns):
        column = F.col(f"box.c{i}")
        if f"c{i}" == places[text_column]:
            column = new
        elif name == size_column and f"c{i}" == places[size_column]:
            column = F.when(changed, F.char_length(new).cast(docs.schema[i].dataType)).otherwise(column)
        columns.append(column.alias(f"c{i}"))
    return out.select(*columns).toDF(*docs.columns)
