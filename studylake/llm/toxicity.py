"""Operator 8: toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

Labels mark documents, so words get theirs by weak supervision: a word of a toxic training text is a toxic token if it or its
beginning has a document frequency in toxic texts that exceeds the one in clean texts by a log ratio whose lower bound (two
standard errors) passes `STRONG`. The field has two states; a word's emission depends on the bin of that lower bound, transitions on the two states. It is
fitted on training texts in two folds: bins come from the other fold's lexicon, so that words seen once do not look certain.

Most words are neutral (the lowest bin) and share one emission; k of them in a row are the k-th power of one 2 x 2 step. So
forward-backward only visits the other words, and is exact for texts of any length.

A document's score is a logistic function of how many different words are likely, and expected, to be toxic. Spans are runs of words whose marginal is at least one half, as byte offsets in the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.bytetext import ALNUM, U64, Sums, arrow_bytes, lower_ascii, slices, word_spans
from studylake.llm.common import pick
from studylake.llm.near_dedup import BANDS, ROWS, minima, shingle_sets
from studylake.llm.samples import SAMPLE_ROWS, held_out, labelled_texts

#: Lower bounds of the log ratio that separate the bins; below the first a word is neutral.
EDGES = np.array([0.75, 1.25, 2.0, 3.0, 4.0])
STRONG = 1.0
#: Words of a training sequence; longer texts give several.
SEQUENCE = 64
#: Sequences the field is fitted on, at most.
SEQUENCES = 4000
#: Bytes of the beginnings of words that count as parts of their own.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7


def _parts(sums: Sums, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, fingerprints) of whole words and of their beginnings, which inflected forms share."""
    out = [(np.arange(len(starts)), sums.spans(starts, ends))]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts >= n)
        out.append((long, sums.spans(starts[long], starts[long] + n) ^ U64(0xA5A5A5A5 * n)))
    return out


class _Words:
    """The words of training texts: parts (word, fingerprint), and the text of each word."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        buf, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        wholes, words, keys, owners, n = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0
        for a, b in slices(at):
            text = lower_ascii(buf[at[a] : at[b]])
            starts, ends, rows = word_spans(text, at[a : b + 1] - at[a], ALNUM)
            parts = _parts(Sums(text), starts, ends)
            wholes.append(parts[0][1])
            for word, key in parts:
                words.append(word + n)
                keys.append(key)
            owners.append(rows + a)
            n += len(starts)
        self.whole = np.concatenate(wholes)
        self.word, self.key, self.owner = np.concatenate(words), np.concatenate(keys), np.concatenate(owners)


class Lexicon:
    """Parts of words whose log ratio has a lower bound above the first edge; seen in two toxic texts at least."""

    def __init__(self, words: _Words, toxic: np.ndarray, use: np.ndarray):
        """toxic, use: for each text, its label and whether it counts here."""
        owner = words.owner[words.word]
        keys, owner = words.key[use[owner]], owner[use[owner]]
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))) if len(keys) else np.zeros(0, bool)
        parts, at = np.unique(keys[new], return_inverse=True)
        bad = np.bincount(at, weights=toxic[owner[new]], minlength=len(parts))
        good = np.bincount(at, minlength=len(parts)) - bad
        n_bad, n_good = toxic[use].sum(), (1 - toxic[use]).sum()
        ratio = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
        bound = ratio - 2 * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
        keep = (bound >= EDGES[0]) & (bad >= 2)
        self.parts, self.bounds = parts[keep], bound[keep]

    def bound(self, n_words: int, word: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The largest lower bound among each word's parts."""
        out = np.full(n_words, -np.inf)
        if len(self.parts):
            at = np.minimum(np.searchsorted(self.parts, key), len(self.parts) - 1)
            known = np.flatnonzero(self.parts[at] == key)
            np.maximum.at(out, word[known], self.bounds[at[known]])
        return out


def _bins(bound: np.ndarray) -> np.ndarray:
    """0 for neutral words, then 1 to len(EDGES)."""
    return np.searchsorted(EDGES, bound, "right").astype(np.int64)


def _originals(texts: list[str]) -> np.ndarray:
    """Which texts share no band of minima with an earlier one: copies would make chance words look significant."""
    seen: set[bytes] = set()
    out = np.ones(len(texts), bool)
    for i, members in enumerate(shingle_sets(pa.array(texts, pa.string()), 5)):
        bands = {row.tobytes() + bytes([j]) for j, row in enumerate(minima(members).reshape(BANDS, ROWS))} if len(members) else set()
        out[i] = not (bands & seen)
        seen |= bands
    return out


class Field:
    """Emissions (bin, state) and transitions (state, state), as scores."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    @classmethod
    def fit(cls, bins: np.ndarray, states: np.ndarray, starts: np.ndarray, rounds: int = 100) -> Field:
        """Gradient ascent with momentum on the penalised likelihood of labelled sequences, `starts` where each begins."""
        k = len(EDGES) + 1
        if not len(starts):
            return cls(np.zeros((k, 2)), np.zeros((2, 2)))
        lengths = np.diff(np.append(starts, len(bins)))
        width = int(lengths.max(initial=1))
        at = starts[:, None] + np.arange(width)
        inside = np.arange(width) < lengths[:, None]
        at = np.where(inside, at, 0)
        x, y = bins[at], states[at]
        gold_emit, gold_move = np.zeros((k, 2)), np.zeros((2, 2))
        np.add.at(gold_emit, (x[inside], y[inside]), 1)
        np.add.at(gold_move, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), 1)
        emit, move = np.zeros((k, 2)), np.zeros((2, 2))
        speed = [np.zeros_like(emit), np.zeros_like(move)]
        for _ in range(rounds):
            e, m = np.exp(emit), np.exp(move)
            on = e[x]  # (sequence, word, state)
            forward, backward = np.empty_like(on), np.ones_like(on)
            forward[:, 0] = on[:, 0] / on[:, 0].sum(1, keepdims=True)
            for t in range(1, width):
                p, q = forward[:, t - 1, 0], forward[:, t - 1, 1]
                a, b = (p * m[0, 0] + q * m[1, 0]) * on[:, t, 0], (p * m[0, 1] + q * m[1, 1]) * on[:, t, 1]
                forward[:, t, 0], forward[:, t, 1] = a / (a + b), b / (a + b)
            for t in range(width - 2, -1, -1):
                p, q = on[:, t + 1, 0] * backward[:, t + 1, 0], on[:, t + 1, 1] * backward[:, t + 1, 1]
                a, b = m[0, 0] * p + m[0, 1] * q, m[1, 0] * p + m[1, 1] * q
                here = inside[:, t + 1]
                backward[:, t, 0], backward[:, t, 1] = np.where(here, a / (a + b), 1), np.where(here, b / (a + b), 1)
            pair = forward[:, :-1, :, None] * m * (on * backward)[:, 1:, None, :]
            pair = pair[inside[:, 1:]]
            want_emit, want_move = np.zeros((k, 2)), (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            belief = forward * backward
            belief /= belief.sum(2, keepdims=True)
            for s in range(2):
                want_emit[:, s] = np.bincount(x[inside], weights=belief[..., s][inside], minlength=k)
            # Rare bins and moves must not wait for the common ones: each is scaled by how often it occurs.
            for j, (value, gold, want) in enumerate(((emit, gold_emit, want_emit), (move, gold_move, want_move))):
                slope = (gold - want - 0.1 * value) / np.sqrt(np.maximum(gold.sum(1, keepdims=True), 10) * np.maximum(gold + want, 1))
                speed[j] = 0.8 * speed[j] + 0.3 * slope
                np.clip(value + np.clip(speed[j], -1, 1), -10, 10, out=value)
        for i in range(2, k):  # a bin that training never met is as telling as the one below
            if not gold_emit[i].any():
                emit[i] = emit[i - 1]
        return cls(emit - emit[:, :1], move)

    def marginals(self, bins: np.ndarray, at: np.ndarray, doc: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """The probability of the toxic state for the words that are not neutral (word `at` of text `doc`, in order)."""
        if not len(bins):
            return np.zeros(0)
        e, m = np.exp(self.emit), np.exp(self.move)
        # Powers of the step into a neutral word; its entries are positive, so its eigenvalues are real and differ.
        values, right = np.linalg.eig(m * e[0])
        left, values = np.linalg.inv(right), values / np.abs(values).max()

        def steps(k: np.ndarray) -> np.ndarray:
            return np.einsum("ij,nj,jk->nik", right, values[None, :] ** k[:, None], left)

        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        counts = np.diff(np.append(first, len(doc)))
        place = np.arange(len(doc)) - np.repeat(first, counts)
        gap = np.where(place == 0, at, at - np.concatenate(([0], at[:-1])) - 1)
        after = n_words[doc] - at - 1
        # Texts with most marked words first: the i-th words of all texts that have as many are done together.
        order = np.argsort(-counts, kind="stable")
        having = [order[: np.searchsorted(-counts[order], -i, "left")] for i in range(int(counts.max()))]
        forward, backward = np.empty((len(doc), 2)), np.empty((len(doc), 2))
        for i, texts in enumerate(having):
            live = first[texts] + i
            if i:
                state = np.einsum("nj,njk->nk", forward[live - 1], steps(gap[live])) @ m
            else:
                led = np.einsum("j,njk->nk", e[0], steps(np.maximum(gap[live] - 1, 0))) @ m
                state = np.where(gap[live, None] > 0, led, 1.0)
            state = state * e[bins[live]]
            forward[live] = state / state.sum(1, keepdims=True)
        for i in reversed(range(len(having))):
            texts = having[i]
            live = first[texts] + i
            last = counts[texts] == i + 1
            follow = np.where(last, live, np.minimum(live + 1, len(doc) - 1))
            more = np.einsum("njk,nk->nj", steps(gap[follow]), (e[bins[follow]] * backward[follow]) @ m.T)
            state = np.where(last[:, None], steps(after[live]).sum(2), more)
            backward[live] = state / state.sum(1, keepdims=True)
        both = forward * backward
        return both[:, 1] / both.sum(1)


def _spread(bins: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index among all words, word number in its text, text) of the words that are not neutral."""
    found = np.flatnonzero(bins)
    starts = np.searchsorted(owners, owners[found])
    return found, found - starts, owners[found]


def _features(probability: np.ndarray, key: np.ndarray, doc: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Of each text: one, and (as logarithms) how many different words have a marginal of one half at least, how many are expected
    to be toxic, and the latter in a thousand words; a chance word that a text repeats counts once."""
    n = len(n_words)
    order = np.lexsort((-probability, key, doc))
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    first = order[np.concatenate(([True], ~same))] if len(order) else order
    likely = np.bincount(doc[first], weights=probability[first] >= 0.5, minlength=n)
    expected = np.bincount(doc[first], weights=probability[first], minlength=n)
    share = np.log1p(np.minimum(1000 * expected / np.maximum(n_words, 50), 20))
    return np.stack((np.ones(n), np.log1p(np.minimum(likely, 5)), np.log1p(np.minimum(expected, 5)), share), axis=1)


def _spaced(used: np.ndarray, limit: int) -> np.ndarray:
    """At most `limit` of the used, at even distances from the first to the last."""
    at = np.flatnonzero(used)
    if len(at) <= limit:
        return used
    out = np.zeros(len(used), bool)
    out[at[np.linspace(0, len(at) - 1, limit).astype(np.int64)]] = True
    return out


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Newton's method for penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Toxicity:
    """Lexicon, field and the logistic weights of the document score; `learn` takes (text, 0 or 1)."""

    def __init__(self, lexicon: Lexicon, field: Field, weights: np.ndarray):
        self.lexicon, self.field, self.weights = lexicon, field, weights

    @classmethod
    def learn(cls, rows: list[tuple[str, int]]) -> Toxicity:
        originals = _originals([t for t, _ in rows])
        rows = [row for row, own in zip(rows, originals) if own]
        texts, toxic = [t for t, _ in rows], np.array([y for _, y in rows], np.float64)
        words = _Words(texts)
        n, owner = len(words.owner), words.owner
        whole = Lexicon(words, toxic, np.ones(len(rows), bool))
        n_words = np.bincount(owner, minlength=len(rows))
        fold = np.arange(len(rows)) % 2
        bound = np.empty(n)
        for f in (0, 1):
            bound = np.where(fold[owner] == f, Lexicon(words, toxic, fold != f).bound(n, words.word, words.key), bound)
        bins = _bins(bound)
        states = ((whole.bound(n, words.word, words.key) >= STRONG) & (toxic[owner] > 0)).astype(np.int64)
        place = np.arange(n) - np.searchsorted(owner, owner)
        sequence = np.flatnonzero(place % SEQUENCE == 0)
        lengths = np.diff(np.append(sequence, n))
        # Sequences without any marked word tell the same again and again: one in ten of them.
        marked = np.add.reduceat((bins > 0) | (states > 0), sequence) > 0 if len(sequence) else np.zeros(0, bool)
        used = _spaced(marked | (np.arange(len(sequence)) % 10 == 0), SEQUENCES)
        chosen = np.repeat(used, lengths)
        starts = np.cumsum(lengths[used]) - lengths[used]
        field = Field.fit(bins[chosen], states[chosen], starts)
        found, at, doc = _spread(bins, owner)
        probability = field.marginals(bins[found], at, doc, n_words)
        x = _features(probability, words.whole[found], doc, n_words)
        return cls(whole, field, _logistic(x, toxic) if toxic.any() else np.array([-30.0, 0, 0, 0]))

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
        """(scores, starts and ends of toxic spans as bytes from the start of each text)."""
        text = lower_ascii(buf)
        starts, ends, owners = word_spans(text, offsets, ALNUM)
        n = len(offsets) - 1
        n_words = np.bincount(owners, minlength=n)
        bound = np.full(len(starts), -np.inf)
        parts = _parts(Sums(text), starts, ends)
        for word, key in parts:
            np.maximum(bound, self.lexicon.bound(len(starts), word, key), out=bound)
        bins = _bins(bound)
        found, at, doc = _spread(bins, owners)
        probability = self.field.marginals(bins[found], at, doc, n_words)
        x = _features(probability, parts[0][1][found], doc, n_words) @ self.weights
        opens: list[list[int]] = [[] for _ in range(n)]
        closes: list[list[int]] = [[] for _ in range(n)]
        hot = np.flatnonzero(probability >= 0.5)
        for i, j in enumerate(hot):
            d, w = int(doc[j]), found[j]
            a, b = int(starts[w] - offsets[d]), int(ends[w] - offsets[d])
            if i and hot[i - 1] == j - 1 and doc[j - 1] == d and at[j - 1] == at[j] - 1:
                closes[d][-1] = b
            else:
                opens[d].append(a)
                closes[d].append(b)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30))), opens, closes


OUT = "doc_id long, held_out boolean, score double, predicted int, span_starts array<long>, span_ends array<long>"
_ARROW_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()),
        ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64())),
    ]
)


def learn_toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Toxicity:
    """Fitted on about `limit` labelled rows that are not held out."""
    return Toxicity.learn(labelled_texts(docs, labels, "toxic", limit))


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """Toxic spans and a score for each row's whole text.

    Returns doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.7), span_starts and span_ends (bytes). NULL, empty and
    wordless texts have no spans and the lowest score, that of a text without marked words; without any label all scores are
    next to 0. NULL labels are left out. Rows that repeat each get their row; no rows give none; other columns are ignored.
    """
    rows = pick(docs, doc_id=id_column, text=text_column)
    marks = pick(labels, doc_id=id_column, toxic=label_column)
    model = learn_toxicity(rows, marks)

    def run(batches):
        for batch in batches:
            buf, at = arrow_bytes(batch.column("text"))
            scores, opens, closes = [], [], []
            for a, b in slices(at):
                s, o, c = model.score(buf[at[a] : at[b]], at[a : b + 1] - at[a])
                scores.append(s)
                opens += o
                closes += c
            score = np.concatenate(scores) if scores else np.zeros(0)
            arrays = [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(opens, pa.list_(pa.int64())), pa.array(closes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *arrays], schema=_ARROW_OUT)

    keyed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return keyed.mapInArrow(run, OUT)
