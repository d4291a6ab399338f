"""Operator 3: benchmark passages in training documents, by winnowing; built-in functions only.

A window is `span` consecutive words of a benchmark item, or all words of a shorter item. Each document and item keeps the
smallest hash of every `span - gram + 1` consecutive word `gram`-grams. Two texts that share a span choose the same smallest
hash in it, so a document without a common fingerprint holds no window: it is settled without looking at its windows. For
the others every window is compared word by word. Items shorter than a span are found by hashes of as many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import by_place, free_shuffles, materialize, pick

SPAN, GRAM = 10, 5
#: Windows of benchmark items up to which they are broadcast (some 100 bytes each); beyond that they are joined by shuffle.
BROADCAST_WINDOWS = 200_000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """A-Z lower-cased runs of letters, digits and all beyond ASCII; `lower` alone would change other letters too."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, BREAK), "")


def _each(n: Column, width: int, make) -> Column:
    """make(i) for each start of `width` of n things; empty if there are fewer."""
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), make)).otherwise(F.array().cast("array<bigint>"))


def _grams(width: int) -> Column:
    hashes = F.col("hashes")
    if width == 1:
        return hashes
    return _each(F.size(hashes), width, lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(width))))


def _with_length(n: int):
    return lambda h: F.xxhash64(h, F.lit(n))


def _fingerprints(df: DataFrame, short: list[int], span: int, gram: int) -> DataFrame:
    """`df` (words) with `prints`: winnowed hashes of grams, and hashes of as many words as each short item has."""
    window = span - gram + 1
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("grams", _grams(gram))
    grams = F.col("grams")
    least = (lambda i: F.least(*(F.get(grams, i + j) for j in range(window)))) if window > 1 else (lambda i: F.get(grams, i))
    parts = [F.array_distinct(_each(F.size(grams), window, least))]
    # The length is hashed with a short window, lest it be taken for a gram.
    parts += [F.array_distinct(F.transform(_grams(n), _with_length(n))) for n in short]
    return df.withColumn("prints", F.concat(*parts)).drop("hashes", "grams", "words")


def _windows(df: DataFrame, lengths: list[int]) -> DataFrame:
    """A row (first, length, window) for each window of `words` of each of the lengths."""
    words = F.col("words")

    def of(n: int) -> Column:
        def window(i: Column) -> Column:
            return F.struct(i.alias("first"), F.lit(n).alias("length"), F.array_join(F.slice(words, i + 1, n), " ").alias("window"))

        none = F.array().cast("array<struct<first:int,length:int,window:string>>")
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), window)).otherwise(none)

    found = [of(n) for n in lengths]
    return df.withColumn("w", F.explode(F.concat(*found))).drop("words").select("*", "w.first", "w.length", "w.window").drop("w")


def contamination(
    docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """Which words of each document stand in a window of a benchmark item.

    Returns a row per input row: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items (items with such
    windows), items (their ids as strings, sorted), items_sha256 (of the ids, comma-joined), contaminated (n_hit > 0) and
    tkey (a hash of the text). NULL, empty and wordless texts have no words and are clean; items without words have no
    window. Items of one text all count. Rows that repeat an id each get a row. NULL item ids are left out of `items` and
    `n_items` but their windows count as hits. Empty tables give no rows, or only clean ones; other columns are ignored.
    """
    spark = docs.sparkSession
    keyed = pick(docs, doc_id=id_column, text=text_column).select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    items = pick(benchmark, item=item_column, text=item_text_column)
    items = materialize(items.select(F.col("item").cast("string").alias("item"), words_of(F.col("text")).alias("words")), "items")
    sizes = items.where(F.size("words") > 0).select(F.least(F.size("words"), F.lit(span)).alias("n")).distinct()
    lengths = sorted(row.n for row in sizes.collect())  # at most `span` numbers
    short = [n for n in lengths if n < span]

    # Windows of an item: spans of a long one, the whole of a short one.
    long_items, short_items = items.where(F.size("words") >= span), items.where((F.size("words") > 0) & (F.size("words") < span))
    whole = short_items.select("item", F.array_join("words", " ").alias("window"))
    windows = _windows(long_items, [span]).select("item", "window").union(whole)
    windows = windows.groupBy("window").agg(F.collect_set("item").alias("of_items"))
    windows = materialize(windows, "item-windows")
    whole_prints = [_fingerprints(short_items.where(F.size("words") == n), [n], span, gram).select(F.explode("prints").alias("p")) for n in short]
    prints = _fingerprints(long_items, [], span, gram).select(F.explode("prints").alias("p"))
    for more in whole_prints:
        prints = prints.union(more)
    prints = materialize(prints.distinct(), "item-prints")
    small = windows.count() <= BROADCAST_WINDOWS
    hint = F.broadcast if small else (lambda df: df)

    printed = _fingerprints(keyed.select("doc_id", "tkey", words_of(F.col("text")).alias("words")), short, span, gram)
    printed = materialize(printed, "printed")
    suspects = printed.select("doc_id", "tkey", F.explode("prints").alias("p")).join(hint(prints), "p", "left_semi")
    suspects = suspects.select(F.col("doc_id").alias("s_id"), F.col("tkey").alias("s_key")).distinct()
    suspects = materialize(suspects, "suspects")
    free_shuffles(spark)

    texts = keyed.join(suspects, (F.col("tkey") == F.col("s_key")) & F.col("doc_id").eqNullSafe(F.col("s_id")), "left_semi")
    placed = _windows(texts.select("doc_id", "tkey", words_of(F.col("text")).alias("words")), lengths or [span])
    hits = placed.join(hint(windows), "window")
    hits = hits.groupBy("doc_id", "tkey").agg(
        F.array_sort(F.collect_set(F.struct("first", "length"))).alias("spans"), F.collect_set("of_items").alias("of_items")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda at, s: F.struct(
            (at["n"] + F.greatest(F.lit(0), s["first"] + s["length"] - F.greatest(at["end"], s["first"]))).alias("n"),
            F.greatest(at["end"], s["first"] + s["length"]).alias("end"),
        ),
        lambda at: at["n"].cast("long"),
    )
    hits = hits.select(
        F.col("doc_id").alias("h_id"), F.col("tkey").alias("h_key"), covered.alias("hit"),
        F.array_sort(F.array_distinct(F.flatten("of_items"))).alias("found"),
    )
    hits = materialize(hits, "hits")
    out = printed.select("doc_id", "tkey", "n_words").join(
        hits, (F.col("tkey") == F.col("h_key")) & F.col("doc_id").eqNullSafe(F.col("h_id")), "left"
    )
    none = F.array().cast("array<string>")
    return (
        out.select("doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("found", none).alias("items"), "tkey")
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """`docs` without those that hold a window of a benchmark item; all columns stay as they are, of whatever names."""
    found = contamination(docs, benchmark, span, gram, id_column, text_column)
    bad = materialize(found.where("contaminated").select(F.col("doc_id").alias("b_id"), F.col("tkey").alias("b_key")).distinct(), "bad")
    plain, places = by_place(docs)
    boxed = plain.select(F.struct("*").alias("box"), plain[places[id_column]].alias("doc_id"), F.xxhash64(places[text_column]).alias("tkey"))
    same = (F.col("tkey") == F.col("b_key")) & F.col("doc_id").eqNullSafe(F.col("b_id"))
    return boxed.join(bad, same, "left_anti").select("box.*").toDF(*docs.columns)
