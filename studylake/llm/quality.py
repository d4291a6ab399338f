"""Operator 10: document quality by random indexing and a small neural network with calibrated probabilities.

Words and runs of punctuation are tokens; tokens share `VOCABULARY` rows by hash. Each row has a sparse random index vector (two
entries of +1 or -1, made from its hash). A token's context vector is the sum of the index vectors of the two tokens on either
side, over all documents: tasks add up their part, row ranges of the sums are added per range, and the driver gets one matrix
of fixed size. A document is the mean of its tokens' unit vectors, with the share of different tokens and its length in
logarithm beside it. A network of two layers, in numpy, is fitted on a bounded sample of labelled rows; a temperature fitted
on a part of the sample it has not seen turns its output into probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.bytetext import ALNUM, NOT_BLANK, U64, Sums, arrow_bytes, mix, row_bounds, slices
from studylake.llm.common import materialize, pick
from studylake.llm.samples import SAMPLE_ROWS, held_out, labelled_texts

VOCABULARY, WIDTH = 8192, 32
#: Tokens on either side that make the context.
REACH = 2
#: Ranges of rows in which partial sums are added.
RANGES = 16
HIDDEN = 24

_KIND = np.where(~NOT_BLANK, 0, np.where(ALNUM | ((np.arange(256) | 0x20) >= 0x61) & ((np.arange(256) | 0x20) <= 0x7A), 1, 2)).astype(np.int8)


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the vocabulary, text, fingerprint) of each run of letters and digits and each run of other visible bytes."""
    kind = _KIND[buf]
    edge = np.ones(len(buf) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    visible = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[visible], ends[visible]
    key = Sums(buf, 2).spans(starts, ends)
    return (key % U64(VOCABULARY)).astype(np.int64), np.searchsorted(offsets, starts, "right") - 1, key


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs of each row's two entries."""
    h = mix(np.arange(VOCABULARY, dtype=U64) + U64(1))
    columns = np.stack((h % U64(WIDTH), (h >> U64(16)) % U64(WIDTH)), 1).astype(np.int64)
    signs = np.stack(((h >> U64(40)) & U64(1), (h >> U64(41)) & U64(1)), 1).astype(np.int64) * 2 - 1
    return columns, signs


def _context_sums(batches):
    """A row for each range of the vocabulary: the sums of a task's texts."""
    columns, signs = index_vectors()
    total = np.zeros(VOCABULARY * WIDTH)
    for batch in batches:
        buf, at = arrow_bytes(batch.column("text"))
        for a, b in slices(at):
            row, text, _ = tokens(buf[at[a] : at[b]], at[a : b + 1] - at[a])
            for step in range(1, REACH + 1):
                together = np.flatnonzero(text[step:] == text[:-step])
                left, right = row[together], row[together + step]
                for one, other in ((left, right), (right, left)):
                    for j in range(2):
                        total += np.bincount(one * WIDTH + columns[other, j], weights=signs[other, j], minlength=VOCABULARY * WIDTH)
    parts = total.astype(np.int64).reshape(RANGES, -1)
    used = [i for i in range(RANGES) if parts[i].any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["part", "sums"]
    )


def _add_sums(rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(blob.as_py(), np.int64) for blob in rows.column("sums")], axis=0)
    return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors (VOCABULARY, WIDTH) from all of docs (text); rows without context are zero."""
    partial = docs.select("text").mapInArrow(_context_sums, "part int, sums binary")
    # Some tasks' sums are added before the rest, so that no task gets those of all.
    dealt = partial.withColumn("deal", (F.rand(5) * 32).cast("int"))
    first = dealt.groupBy("part", "deal").applyInArrow(_add_sums, "part int, sums binary")
    rows = materialize(first.groupBy("part").applyInArrow(_add_sums, "part int, sums binary"), "context-sums").collect()
    out = np.zeros((RANGES, VOCABULARY * WIDTH // RANGES))
    for r in rows:  # RANGES rows of a fixed size
        out[r["part"]] = np.frombuffer(r["sums"], np.int64)
    vectors = out.reshape(VOCABULARY, WIDTH)
    # Frequent neighbours would make all vectors alike: squash the sums, then take out the common direction.
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    used = np.abs(vectors).sum(1) > 0
    vectors[used] -= vectors[used].mean(0) if used.any() else 0
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0).astype(np.float32)


def pooled(vectors: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of WIDTH + 2 numbers for each text; zeros without tokens."""
    n = len(offsets) - 1
    row, text, key = tokens(buf, offsets)
    out = np.zeros((n, vectors.shape[1] + 2), np.float32)
    if not len(row):
        return out
    bounds = row_bounds(text, n)
    counts = np.diff(bounds)
    have = counts > 0
    out[have, :-2] = np.add.reduceat(vectors[row], bounds[:-1][have], axis=0) / counts[have, None]
    order = np.lexsort((key, text))
    new = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1])))
    different = np.bincount(text[order][new], minlength=n)
    out[have, -2] = different[have] / counts[have]
    out[have, -1] = np.log(counts[have]) / 5
    return out


class Network:
    """Two layers: tanh, then a logit; inputs are standardised, the logit is divided by a temperature."""

    def __init__(self, mean, scale, layers, temperature):
        self.mean, self.scale, self.layers, self.temperature = mean, scale, layers, temperature

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 400) -> Network:
        """Adam on the cross-entropy of four fifths of the rows; the temperature on the last fifth."""
        rng = np.random.default_rng(10)
        mean, scale = x.mean(0), x.std(0) + 1e-3
        order = rng.permutation(len(x))
        cut = max(1, len(x) // 5)
        check, train = order[:cut], order[cut:] if len(x) > 4 else order
        z = (x - mean) / scale
        layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
        a, t = z[train], y[train]
        for i in range(1, rounds + 1):
            h = np.tanh(a @ layers[0] + layers[1])
            p = 1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -30, 30)))
            d = (p - t) / len(t)
            back = np.outer(d, layers[2]) * (1 - h * h)
            slopes = [a.T @ back + 1e-3 * layers[0], back.sum(0), h.T @ d + 1e-3 * layers[2], d.sum(keepdims=True)]
            for w, g, m, v in zip(layers, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.02 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        logit = np.tanh(z[check] @ layers[0] + layers[1]) @ layers[2] + layers[3]
        options = np.exp(np.linspace(-1, 2, 61))
        loss = [np.mean(np.logaddexp(0, logit / c) - y[check] * logit / c) for c in options]
        return cls(mean, scale, layers, float(options[int(np.argmin(loss))]))

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        logit = np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -30, 30)))


OUT = "doc_id long, held_out boolean, score double, predicted int"
_ARROW_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """A quality score for each row's whole text.

    Returns doc_id, held_out, score (0 to 1) and predicted (1 from a score of 0.5). NULL, empty and blank texts are the zero vector and
    get the network's score of it; without any label every score is 0.5. NULL labels are left out. Rows that repeat each get
    their row; no rows give none; other columns are ignored.
    """
    rows = pick(docs, doc_id=id_column, text=text_column)
    vectors = word_vectors(rows)
    sample = labelled_texts(rows, pick(labels, doc_id=id_column, quality=label_column), "quality", SAMPLE_ROWS)
    model = None
    if sample:
        raw = [text.encode() for text, _ in sample]
        buf, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        x = np.concatenate([pooled(vectors, buf[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in slices(at)])
        model = Network.fit(x.astype(np.float64), np.array([y for _, y in sample], np.float64))

    def run(batches):
        for batch in batches:
            buf, at = arrow_bytes(batch.column("text"))
            parts = [pooled(vectors, buf[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in slices(at)]
            x = np.concatenate(parts) if parts else np.zeros((0, WIDTH + 2))
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                schema=_ARROW_OUT,
            )

    keyed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return keyed.mapInArrow(run, OUT)
