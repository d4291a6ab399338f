"""Operator 5: near duplicates by MinHash, banding, signature checks, full-set confirmation and components.

A document is the set of its distinct word shingles; two documents are linked if the sets' Jaccard similarity reaches the
threshold. Documents of one set are one node from the start.

- 252 minima of linear permutations of 32 bits, 42 bands of 6. A pair at 0.8 misses all bands with probability below 3e-6.
- Nodes of one bucket (band and its minima) are candidates. Each node is first compared with its hub, the candidate with most
  collisions, which in a family of copies is nearly always their common original. Linked nodes form classes.
- Only buckets that still hold several classes need more: every node outside the bucket's main class is compared with the
  whole family (nodes of one hub) of each node of another class. So all candidate pairs are either compared or already in
  one class, and no link between classes is lost; pairs themselves are never listed.
- A comparison first looks at the share of equal minima and then counts the common shingles of the full sets. Families
  meet in blocks of at most about 64 by 64 nodes, whatever their size, so a family of a third of all documents is spread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.bytetext import NOT_BLANK, U64, Sums, arrow_bytes, lower_ascii, mix, row_bounds, slices, word_spans
from studylake.llm.common import by_place, free_shuffles, materialize, pick
from studylake.llm.components import components

BANDS, ROWS = 42, 6
#: Nodes of one side of a block.
BLOCK = 64
#: Pairs whose share of equal minima lies this far below the threshold are not confirmed: over six standard deviations.
MARGIN = 0.16

_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_ODD = _RNG.integers(0, 2**63, 64, dtype=U64) * U64(2) + U64(1)

SIGNED = "doc_id long, tkey long, n_shingles long, node long, bands array<long>, sig binary"
_ARROW_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()), ("tkey", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()),
        ("bands", pa.list_(pa.int64())), ("sig", pa.binary()),
    ]
)


def shingle_sets(column: pa.Array, size: int):
    """Each row's distinct shingles as sorted 64-bit fingerprints; fewer words than `size` make one shingle, none no set."""
    buf, at = arrow_bytes(column)
    for a, b in slices(at):
        text = lower_ascii(buf[at[a] : at[b]])
        offsets = at[a : b + 1] - at[a]
        starts, ends, rows = word_spans(text, offsets, NOT_BLANK)
        words = Sums(text).spans(starts, ends)
        grams = np.zeros(max(len(words) - size + 1, 0), U64)
        for i in range(size if len(grams) else 0):
            grams += words[i : i + len(grams)] * _ODD[i % 64]
        grams = mix(grams)
        bounds = row_bounds(rows, b - a)
        for i in range(b - a):
            x, y = int(bounds[i]), int(bounds[i + 1])
            if y - x >= size:
                yield np.unique(grams[x : y - size + 1])
            elif y > x:
                yield mix(np.sum(words[x:y] * _ODD[: y - x], keepdims=True) + U64(y - x))
            else:
                yield np.zeros(0, U64)


def minima(members: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    values = (members >> U64(32)).astype(np.uint32)
    for i in range(0, len(values), 2048):
        np.minimum(low, (values[i : i + 2048, None] * _A + _B).min(0), out=low)
    return low


def _signed(size: int):
    weights = _RNG_BAND.copy()

    def sign(batches):
        for batch in batches:
            counts, nodes, bands, sigs = [], [], [], []
            for members in shingle_sets(batch.column("text"), size):
                counts.append(len(members))
                if not len(members):
                    nodes.append(None)
                    bands.append(None)
                    sigs.append(None)
                    continue
                both = mix(mix(members).sum(keepdims=True) + U64(len(members)))[0] ^ np.bitwise_xor.reduce(members)
                nodes.append(int(both.astype(np.int64)))
                low = minima(members)
                keys = mix((low.reshape(BANDS, ROWS).astype(U64) * weights).sum(1) + np.arange(BANDS, dtype=U64) * _ODD[7])
                bands.append(keys.astype(np.int64))
                sigs.append((low & np.uint32(255)).astype(np.uint8).tobytes())
            columns = [batch.column("doc_id"), batch.column("tkey"), counts, nodes, bands, sigs]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _ARROW_SIGNED)], schema=_ARROW_SIGNED
            )

    return sign


_RNG_BAND = _RNG.integers(0, 2**63, ROWS, dtype=U64) * U64(2) + U64(1)

_ARROW_SETS = pa.schema(
    [("node", pa.int64()), ("hub", pa.int64()), ("blocks", pa.int32()), ("sig", pa.binary()), ("members", pa.binary())]
)


def _sets_of(size: int):
    def sets(batches):
        for batch in batches:
            blobs = [members.tobytes() for members in shingle_sets(batch.column("text"), size)]
            kept = [batch.column(name).cast(_ARROW_SETS.field(name).type) for name in _ARROW_SETS.names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(blobs, pa.binary())], schema=_ARROW_SETS)

    return sets


_ARROW_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set on the left has in common with each on the right."""
    both = left + right
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, token, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = times[token] > 1
    token, owner = token[shared], owner[shared]
    _, token = np.unique(token, return_inverse=True)
    out = np.zeros((len(left), len(right)), np.float32)
    width, order = 1 << 15, np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        x, y = np.searchsorted(token, [low, low + width])
        cells = np.zeros((len(both), width), np.float32)
        cells[owner[x:y], token[x:y] - low] = 1
        out += cells[: len(left)] @ cells[len(left) :].T
    return out.astype(np.int64)


def _compare(percent: int):
    def links(block: pa.Table) -> pa.Table:
        node = block.column("node").to_numpy()
        guest = block.column("guest").to_numpy(zero_copy_only=False)
        _, first = np.unique(np.stack((node, guest.astype(np.int64))), axis=1, return_index=True)
        g, m = [i for i in first if guest[i]], [i for i in first if not guest[i]]
        if not g or not m:
            return _ARROW_LINKS.empty_table()
        group = block.column("class").to_numpy()
        sets = {i: np.frombuffer(block.column("members")[i].as_py(), U64) for i in (*g, *m)}
        sigs = {i: np.frombuffer(block.column("sig")[i].as_py(), np.uint8) for i in (*g, *m)}
        sizes = np.array([len(sets[i]) for i in g])[:, None], np.array([len(sets[i]) for i in m])[None, :]
        alike = (np.stack([sigs[i] for i in g])[:, None, :] == np.stack([sigs[i] for i in m])[None, :, :]).mean(2)
        open_ = (group[g][:, None] != group[m][None, :]) & (alike >= percent / 100 - MARGIN)
        open_ &= 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
        left, right = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(left):
            return _ARROW_LINKS.empty_table()
        common = common_counts([sets[g[i]] for i in left], [sets[m[i]] for i in right])
        union = sizes[0][left] + sizes[1][:, right] - common
        x, y = np.nonzero((100 * common >= percent * union) & open_[np.ix_(left, right)])
        return pa.Table.from_arrays([pa.array(node[[g[i] for i in left[x]]]), pa.array(node[[m[i] for i in right[y]]])], schema=_ARROW_LINKS)

    return links


def _roots_of_hubs(links: DataFrame, hubs: DataFrame) -> DataFrame:
    """hubs with the class their links (a = hub, b = node) put each node in. Hubs rise in weight, so links form trees: every
    node takes its parent's parent until that is a root."""
    up = links.select(F.col("b").alias("node"), F.col("a").alias("up"))
    state = hubs.select("node").join(up, "node", "left").select("node", F.coalesce("up", "node").alias("up"))
    state = materialize(state, "parents")
    while True:
        above = state.select(F.col("node").alias("up"), F.col("up").alias("top"))
        state = materialize(state.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "parents")
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    return hubs.join(state.select("node", F.col("up").alias("class")), "node")


def _classes(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """`nodes` with their class: the smallest node their links reach, or themselves."""
    roots = materialize(components(links), "roots")
    return nodes.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")


def _linked(nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """All links (a, b) between nodes, or as many as their components need."""
    spark = docs.sparkSession
    exploded = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = materialize(exploded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    placed = materialize(exploded.join(crowded, "bucket"), "placed")
    del exploded
    free_shuffles(spark)
    if placed.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    weights = placed.groupBy("node").agg(F.sum(F.col("n") - 1).alias("weight"))
    placed = materialize(placed.join(weights, "node").select("bucket", "node", "weight"), "placed")
    centers = materialize(placed.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("center")), "centers")
    hubs = materialize(
        placed.join(centers, "bucket").groupBy("node").agg(F.max("center").alias("center")).select("node", F.col("center.node").alias("hub")),
        "hubs",
    )
    families = materialize(hubs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "families")
    # Full sets of the candidates only, from the text of one row of each node.
    wanted = (
        hubs.join(nodes.select("node", "sig", "row"), "node").join(families, "hub")
        .select("node", "hub", "blocks", "sig", F.col("row.doc_id").alias("row_id"), F.col("row.tkey").alias("row_key"))
    )
    wanted = materialize(wanted, "wanted")
    texts = docs.join(wanted, (docs.tkey == wanted.row_key) & docs.doc_id.eqNullSafe(wanted.row_id))
    texts = texts.select("node", "hub", "blocks", "sig", "text")
    sets = materialize(texts.mapInArrow(_sets_of(size), "node long, hub long, blocks int, sig binary, members binary"), "sets")
    del texts
    free_shuffles(spark)
    sets = sets.withColumn("mine", F.pmod(F.hash("node"), F.col("blocks")))

    # First every node with its hub.
    hub_sets = families.withColumnRenamed("hub", "node").join(sets.select("node", "sig", "members"), "node")
    stars = (
        sets.where("node <> hub")
        .select("hub", F.col("mine").alias("block"), "node", F.lit(False).alias("guest"), F.col("node").alias("class"), "sig", "members")
        .union(
            hub_sets.select(
                F.col("node").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node",
                F.lit(True).alias("guest"), F.col("node").alias("class"), "sig", "members",
            )
        )
    )
    compare = _compare(percent)
    first = materialize(stars.groupBy("hub", "block").applyInArrow(compare, "a long, b long"), "links")

    # Then what stands outside its bucket's main class with the families of the bucket's other classes.
    classed = materialize(_roots_of_hubs(first, hubs), "classed")
    places = placed.join(classed, "node")
    mixed = (
        places.groupBy("bucket")
        .agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max(F.struct("weight", "class")).alias("main"))
        .where("low <> high")
        .select("bucket", F.col("main.class").alias("main"))
    )
    places = materialize(places.join(materialize(mixed, "mixed"), "bucket"), "mixed-places")
    # One row for each family in a bucket; it holds another class than a node's unless all its classes are the node's.
    others = materialize(places.groupBy("bucket", "hub").agg(F.min("class").alias("low"), F.max("class").alias("high")), "others")
    meets = places.where("class <> main").select("bucket", "node", "class").join(others, "bucket").where("class <> low OR class <> high")
    meets = materialize(meets.select("node", "class", "hub").distinct(), "meets")
    guests = materialize(meets.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("guest_blocks")), "guests")
    sized = families.join(guests, "hub")
    coming = (
        meets.join(materialize(sized, "sized"), "hub")
        .withColumn("guest_block", F.pmod(F.hash("node"), F.col("guest_blocks")))
        .select("node", "class", "hub", "guest_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        .join(sets.select("node", "sig", "members"), "node")
    )
    there = (
        sets.drop("blocks").join(guests, "hub").join(classed.select("node", "class"), "node")
        .select("hub", F.col("mine").alias("block"), F.explode(F.sequence(F.lit(0), F.col("guest_blocks") - 1)).alias("guest_block"),
                "node", F.lit(False).alias("guest"), "class", "sig", "members")
    )
    coming = coming.select("hub", "block", "guest_block", "node", F.lit(True).alias("guest"), "class", "sig", "members")
    second = there.union(coming).groupBy("hub", "block", "guest_block").applyInArrow(compare, "a long, b long")
    return first.union(materialize(second, "links"))


def _sign_all(docs: DataFrame, size: int) -> DataFrame:
    return materialize(docs.select("doc_id", "tkey", "text").mapInArrow(_signed(size), SIGNED), "signed")


def _node_classes(docs: DataFrame, signed: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, class, doc_id, row) for each distinct set: its class, the smallest id of its rows, and one (doc_id, tkey) of them."""
    nodes = (
        signed.where("node IS NOT NULL").groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.max(F.struct("doc_id", "tkey")).alias("row"),
             F.min(F.struct("doc_id", "tkey")).alias("first_row"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    )
    nodes = materialize(nodes, "nodes")
    links = _linked(nodes, docs, size, percent)
    return materialize(_classes(links, nodes.select("node", "doc_id", "first_row")), "node-classes")


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return pick(docs, doc_id=id_column, text=text_column).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tkey")
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Link documents whose shingle sets have 100 * intersection >= percent * union; a row for each input row.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable, itself included), kept (doc_id = component_id)
    and node (the set's key; NULL without words). Words are runs of other than ASCII white space, A-Z lower-cased; a text of
    fewer words than `shingle` is one shingle; NULL, empty and blank texts have an empty set, are linked with nothing and
    kept. Rows that repeat an id are documents of their own: each gets a row. Rows with a NULL id are linked and pass links
    on, but are kept only if no linked row has an id. No rows give no rows; other columns are ignored.
    """
    keyed = _keyed(docs, id_column, text_column)
    signed = _sign_all(keyed, shingle)
    nodes = _node_classes(keyed, signed, shingle, percent)
    least = materialize(nodes.groupBy("class").agg(F.min("doc_id").alias("component_id")), "least")
    found = materialize(nodes.join(least, "class").select("node", "component_id"), "found")
    out = signed.select("doc_id", "n_shingles", "node").join(found, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "node").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with one row of each group of linked documents: of smallest id, then of smallest text hash.

    Texts without words are linked with nothing and stay, all of them. Rows equal in id and text count once. All columns are
    kept as they are, of whatever names.
    """
    plain, places = by_place(docs)
    keyed = _keyed(docs, id_column, text_column)
    signed = _sign_all(keyed, shingle)
    nodes = _node_classes(keyed, signed, shingle, percent)
    # How many rows share each id and text: one of them stays, unless the text has no words.
    times = signed.groupBy("doc_id", "tkey").agg(F.when(F.first("node").isNull(), 1).otherwise(F.count("*")).alias("times"))
    chosen = nodes.groupBy("class").agg(F.min("first_row").alias("row")).select("row.doc_id", "row.tkey")
    empty = signed.where("node IS NULL").select("doc_id", "tkey").distinct()
    same = lambda x, y: (x.tkey == y.tkey) & x.doc_id.eqNullSafe(y.doc_id)
    chosen, times = materialize(chosen.union(empty), "chosen"), materialize(times, "times")
    chosen = chosen.join(times, same(chosen, times)).select(
        chosen.doc_id.alias("kept_id"), chosen.tkey.alias("kept_key"), "times"
    )
    chosen = materialize(chosen, "chosen-rows")
    boxed = plain.select(
        F.struct("*").alias("box"), plain[places[id_column]].cast("long").alias("doc_id"), F.xxhash64(places[text_column]).alias("tkey")
    )
    rows = boxed.join(chosen, (boxed.tkey == chosen.kept_key) & boxed.doc_id.eqNullSafe(chosen.kept_id))
    out = rows.where("times = 1").select("box")
    if not chosen.where("times > 1").isEmpty():
        out = out.union(rows.where("times > 1").dropDuplicates(["doc_id", "tkey"]).select("box"))
    return out.select("box.*").toDF(*docs.columns)
