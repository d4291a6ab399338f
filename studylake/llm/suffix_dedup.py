"""Operator 1: exact substring removal by blockwise suffix sorting over a difference cover.

Two suffixes tie when their first `length` bytes are equal; bytes covered by a tied prefix go. Sorting every suffix at once
needs memory in proportion to all text, so, as in blockwise suffix-array construction:

1. **Cover sample.** Positions whose remainder modulo v lies in a difference cover D (Colbourn and Ling's rule) are ranked
   by their first `length - v + 1` bytes. For any two positions i, j there is a shift below v that takes both into the
   sample, so suffixes that tie over `length` bytes have tied samples at the same distance. A suffix without a tied sample
   in reach is settled by the ranks alone and is never sorted.
2. **Suffix buckets.** The suffixes left are dealt to buckets; each task sorts one bucket at a time and finds the ties.
3. **Removal.** Each document marks the bytes of its tied suffixes.

Ranks and order are those of fingerprints of the bytes (64 bits, and the bucket comes from a second, independent
fingerprint in step 2), because only ties matter, not which suffix is smaller.

The unit of exchange is a chunk: a set of documents from one input split. A chunk sends each distinct key once with a mark
if it holds it more than once, so a key that holds a third of all positions arrives at most once per chunk, and gets back
one bit for each key; text and positions never leave their chunk. The text is written once, bucketed by chunk, to the shared
folder, and later steps read it there without another shuffle.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.bytetext import U64, Sums, arrow_bytes, slices
from studylake.llm.common import free_shuffles, materialize, partitions, pick, split_bytes
from studylake.session import scratch_path

#: Bytes of an input split that become one chunk, by a hash of the document id.
CHUNK_BYTES = 4 << 20
#: Bytes of text whose keys make one bucket, which a task sorts at once.
BUCKET_BYTES = 8 << 20
KEYS = "round int, chunk int, bucket int, once binary, many binary"
TIES = "round int, chunk int, bucket int, tied binary"
OUT = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, "
    "span_starts array<long>, span_ends array<long>"
)
_ARROW_KEYS = pa.schema(
    [("round", pa.int32()), ("chunk", pa.int32()), ("bucket", pa.int32()), ("once", pa.binary()), ("many", pa.binary())]
)
_ARROW_TIES = pa.schema([("round", pa.int32()), ("chunk", pa.int32()), ("bucket", pa.int32()), ("tied", pa.binary())])


def difference_cover(length: int) -> tuple[int, np.ndarray]:
    """(v, D): the largest cover of the rule whose modulus leaves a sixth of `length` to compare; every position if none."""
    r = -1
    while 24 * (r + 1) ** 2 + 36 * (r + 1) + 13 <= length * 0.85:
        r += 1
    if r < 0:
        return 1, np.zeros(1, np.int64)
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0, *steps])


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences, bytes of one significance together."""
    if not len(keys):
        return b""
    planes = np.diff(keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T
    return len(keys).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U64)
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(U64), dtype=U64)


def _pieces(table: pa.Table):
    """(bytes, offsets, index of the first row) of slices of a chunk's texts."""
    first = 0
    for column in table.column("text").chunks:
        buf, at = arrow_bytes(column)
        for a, b in slices(at):
            yield buf[at[a] : at[b]], at[a : b + 1] - at[a], first + a
        first += len(column)


def _room(offsets: np.ndarray) -> np.ndarray:
    """For each byte, how many bytes its document has from there on."""
    sizes = np.diff(offsets)
    return np.repeat(offsets[1:], sizes) - np.arange(offsets[-1])


def _sample(offsets: np.ndarray, length: int) -> np.ndarray:
    """Cover positions with room for their prefix; remainders count from the start of each document."""
    v, cover = difference_cover(length)
    wanted = np.zeros(v, bool)
    wanted[cover] = True
    sizes = np.diff(offsets)
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
    return np.flatnonzero(wanted[within % v] & (_room(offsets) >= length - v + 1))


class _Dealt:
    """A chunk's keys, made distinct and dealt to buckets; the same again whenever it is made from the same chunk."""

    def __init__(self, keys: np.ndarray, buckets: np.ndarray, n_buckets: int):
        self.order = np.argsort(keys)
        key, bucket = keys[self.order], buckets[self.order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1]))) if len(key) else np.zeros(0, bool)
        self.group = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.twice = np.diff(np.append(at, len(key))) > 1
        self.key, bucket = key[at], bucket[at]
        small = np.uint16 if n_buckets <= 1 << 16 else np.int32
        self.by_bucket = np.argsort(bucket.astype(small), kind="stable")
        self.edges = np.searchsorted(bucket[self.by_bucket], np.arange(n_buckets + 1))

    def buckets(self):
        """(bucket, distinct keys in it that occur once in the chunk, those that occur more often)."""
        for b in np.flatnonzero(np.diff(self.edges)).tolist():
            own = self.by_bucket[self.edges[b] : self.edges[b + 1]]
            yield b, own[~self.twice[own]], own[self.twice[own]]

    def rows(self, round_: int, chunk: int) -> pa.Table:
        columns: list[list] = [[], [], [], [], []]
        for b, once, many in self.buckets():
            for column, value in zip(columns, (round_, chunk, b, _pack(self.key[once]), _pack(self.key[many]))):
                column.append(value)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW_KEYS.types)], schema=_ARROW_KEYS)

    def tied(self, answers: pa.Table, round_: int) -> np.ndarray:
        """For each key as given: is it tied with another, here or in another chunk?"""
        found = self.twice.copy()
        numbers, buckets = answers.column("round").to_pylist(), answers.column("bucket").to_pylist()
        bits = {b: i for i, (number, b) in enumerate(zip(numbers, buckets)) if number == round_}
        for b, once, _ in self.buckets():
            if b in bits:
                raw = np.frombuffer(answers.column("tied")[bits[b]].as_py(), np.uint8)
                found[once] = np.unpackbits(raw, count=len(once)).astype(bool)
        out = np.empty(len(self.order), bool)
        out[self.order] = found[self.group]
        return out


class _Chunk:
    """The texts of a chunk with their keys. Sums are kept for both steps: eight bytes for each byte of the chunk."""

    def __init__(self, chunk: pa.Table, length: int, n_buckets: int):
        self.number = chunk.column("chunk")[0].as_py()
        self.length, self.n_buckets = length, n_buckets
        self.pieces = [(buf, offsets, first, Sums(buf)) for buf, offsets, first in _pieces(chunk)]

    def _deal(self, found: list[np.ndarray], keys: list[np.ndarray], buckets: list[np.ndarray]) -> tuple[list[np.ndarray], _Dealt]:
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return found, _Dealt(join(keys, U64), join(buckets, np.int32), self.n_buckets)

    def samples(self) -> tuple[list[np.ndarray], _Dealt]:
        """Cover positions of each piece; 40 bits of a fingerprint as the key and the rest for the bucket: a false tie here
        only lets a suffix through to the next step."""
        v, _ = difference_cover(self.length)
        found, keys, buckets = [], [], []
        for _, offsets, _, sums in self.pieces:
            at = _sample(offsets, self.length)
            h = sums.spans(at, at + (self.length - v + 1))
            found.append(at)
            keys.append(h >> U64(24))
            buckets.append(((h & U64(0xFFFFFF)) % U64(self.n_buckets)).astype(np.int32))
        return self._deal(found, keys, buckets)

    def suffixes(self, answers: pa.Table) -> tuple[list[np.ndarray], _Dealt]:
        """Suffixes of each piece with a tied cover sample in reach, by 64 bits and a bucket from other bits."""
        at, dealt = self.samples()
        tied = np.split(dealt.tied(answers, 0), np.cumsum([len(a) for a in at])[:-1])
        found, keys, buckets = [], [], []
        for (buf, offsets, _, sums), positions, mask in zip(self.pieces, at, tied):
            starts = _in_reach(positions[mask], offsets, self.length)
            found.append(starts)
            if len(starts):
                keys.append(sums.spans(starts, starts + self.length))
                other = Sums(buf, 1).spans(starts, starts + self.length)
                buckets.append((other % U64(self.n_buckets)).astype(np.int32))
        return self._deal(found, keys, buckets)


def _in_reach(tied: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Starts with room for `length` bytes of which a tied sample is less than v bytes away."""
    if not len(tied):
        return tied
    v, _ = difference_cover(length)
    change = np.zeros(int(offsets[-1]) + 1, np.int32)
    np.add.at(change, np.maximum(tied - (v - 1), 0), 1)
    np.add.at(change, tied + 1, -1)
    return np.flatnonzero((np.cumsum(change)[:-1] > 0) & (_room(offsets) >= length))


def _sample_keys(length: int, n_buckets: int):
    def keys_of(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, length, n_buckets)
        return chunk.samples()[1].rows(0, chunk.number)

    return keys_of


def _suffix_keys(length: int, n_buckets: int):
    def keys_of(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _ARROW_KEYS.empty_table()
        chunk = _Chunk(table, length, n_buckets)
        return chunk.suffixes(answers)[1].rows(1, chunk.number)

    return keys_of


def _sort_bucket(rows: pa.Table) -> pa.Table:
    """Sorts one bucket; for each chunk, a bit for each key it holds once: is it tied with a key of another chunk?"""
    once = [_unpack(blob.as_py()) for blob in rows.column("once")]
    many = [_unpack(blob.as_py()) for blob in rows.column("many")]
    edges = np.cumsum([0, *map(len, once)])
    keys = np.concatenate([*once, *many])
    order = np.argsort(keys)
    ordered = keys[order]
    equal = ordered[1:] == ordered[:-1]
    tied = np.empty(len(keys), bool)
    tied[order] = np.concatenate((equal, [False])) | np.concatenate(([False], equal)) if len(keys) else False
    columns: list[list] = [[], [], [], []]
    for i in range(rows.num_rows):
        bits = tied[edges[i] : edges[i + 1]]
        if bits.any():
            values = (*(rows.column(c)[i].as_py() for c in ("round", "chunk", "bucket")), np.packbits(bits).tobytes())
            for column, value in zip(columns, values):
                column.append(value)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW_TIES.types)], schema=_ARROW_TIES)


def _runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs of sorted starts."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.concatenate(([True], np.diff(starts) > length)))
    last = np.append(new[1:], len(starts)) - 1
    return starts[new], starts[last] + length


def _remove(length: int, n_buckets: int):
    def removed(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _ARROW_OUT.empty_table()
        chunk = _Chunk(table, length, n_buckets)
        found, dealt = chunk.suffixes(answers)
        masks = np.split(dealt.tied(answers, 1), np.cumsum([len(f) for f in found])[:-1])
        ids = table.column("doc_id").to_pylist()
        rows: list[tuple] = []
        for (buf, offsets, first, _), starts, mask in zip(chunk.pieces, found, masks):
            tied = starts[mask]
            edges = np.searchsorted(tied, offsets)
            raw = buf.tobytes()
            for i in range(len(offsets) - 1):
                a, b = int(offsets[i]), int(offsets[i + 1])
                opens, closes = _runs(tied[edges[i] : edges[i + 1]], length)
                kept, at = [], a
                for x, y in zip(opens.tolist(), closes.tolist()):
                    kept.append(raw[at:x])
                    at = y
                kept.append(raw[at:b])
                rest = b"".join(kept)
                rows.append(
                    (ids[first + i], b - a, b - a - len(rest), len(opens), hashlib.sha256(rest).hexdigest(), rest,
                     (opens - a).tolist(), (closes - a).tolist())
                )
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW_OUT.types)], schema=_ARROW_OUT)

    return removed


_ARROW_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()), ("kept", pa.binary()),
        ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64())),
    ]
)


def remove_repeats(docs: DataFrame, length: int = 400, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts anywhere else in the texts.

    Returns a row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes
    left, as binary, since a cut may fall inside a character), span_starts and span_ends (byte offsets of the removed runs).
    The input is judged as a whole: what is removed elsewhere still counts. Matches never cross rows; overlapping
    occurrences count. NULL or empty text: nothing removed, digest of the empty string. Rows that repeat, also with one id or
    a NULL id, are separate documents and so remove each other's bytes. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    if length < 1:
        raise ValueError("length must be positive")
    spark = docs.sparkSession
    per_split = max(1, split_bytes(spark) // CHUNK_BYTES)
    texts = pick(docs, doc_id=id_column, text=text_column).withColumns(
        {
            "doc_id": F.col("doc_id").cast("long"),
            "size": F.octet_length("text").cast("long"),
            "chunk": (F.spark_partition_id() * per_split + F.pmod(F.hash("doc_id"), F.lit(per_split))).cast("int"),
        }
    )
    # Bucketed by chunk, so that each step reads the text where it lies and only keys are shuffled.
    name = f"suffix_texts_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    texts.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(partitions(spark), "chunk").saveAsTable(name)
    # The frame keeps the files and their buckets; the session's catalog needs no name for them.
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    n = max(partitions(spark), -(-(texts.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES))
    texts = texts.select("doc_id", "text", "chunk")

    def answers(keys: DataFrame) -> DataFrame:
        return materialize(keys.groupBy("bucket").applyInArrow(_sort_bucket, TIES), "suffix-ties")

    samples = answers(texts.groupBy("chunk").applyInArrow(_sample_keys(length, n), KEYS))
    free_shuffles(spark)
    together = texts.groupBy("chunk").cogroup(samples.groupBy("chunk"))
    suffixes = answers(together.applyInArrow(_suffix_keys(length, n), KEYS))
    free_shuffles(spark)
    known = samples.unionByName(suffixes)
    return texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_remove(length, n), OUT)
