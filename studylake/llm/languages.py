"""Operator 9: the languages of a text as a mixture, by expectation-maximisation over n-gram likelihoods.

A text is cut into pieces of a few words; each piece is drawn from one language, whose letter trigrams (in bytes of lower-cased
UTF-8) are a multinomial learned from labelled texts. EM estimates the proportions of the languages in each text. The set of
languages is then the one of highest likelihood less a penalty of half the logarithm of the number of pieces for each language
(the Bayesian information criterion), among the nested sets in order of their proportions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.bytetext import arrow_bytes, slices
from studylake.llm.common import by_place, pick
from studylake.llm.samples import SAMPLE_ROWS, held_out, training_texts

#: Table of trigram probabilities; trigrams share entries by hash.
TABLE_BITS = 16
#: Bytes of a piece.
PIECE = 64
ROUNDS = 25
UNKNOWN = "und"
#: Share that some language must have of a text for the text to be kept by `drop_unknown`.
LEAST_SHARE = 0.5

_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_ASCII_LETTER = ((_BYTES | 0x20) >= 0x61) & ((_BYTES | 0x20) <= 0x7A) & (_BYTES < 0x80)
_FOLD = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def folded(buf: np.ndarray) -> np.ndarray:
    """Letters in lower case (ASCII and Latin-1, which is C3 80 to C3 9E), everything else a blank."""
    out = _FOLD[buf]
    second = np.concatenate(([False], buf[:-1] == 0xC3)) & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97) if len(buf) else []
    out[second] += 0x20
    out[~_LETTER[out]] = 0x20
    return out


def _trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table entry, counts) for the trigram that ends at each byte; trigrams that end in a blank or cross texts do not count."""
    text = folded(buf).astype(np.uint32)
    code = text.copy()
    code[1:] |= text[:-1] << 8
    code[2:] |= text[:-2] << 16
    entry = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)
    counts = text != 0x20
    starts = offsets[:-1][np.diff(offsets) > 0]
    counts[starts] = False
    counts[np.minimum(starts + 1, max(len(buf) - 1, 0))] = False
    return entry, counts


class Languages:
    """Trigram log-probabilities of each language, and the prior belief in each."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, table

    @classmethod
    def learn(cls, rows: list[tuple[str, str]]) -> Languages:
        names = sorted({lang for _, lang in rows})
        counts = np.zeros((len(names), 1 << TABLE_BITS))
        for i, name in enumerate(names):
            raw = [text.encode() for text, lang in rows if lang == name]
            buf = np.frombuffer(b"".join(raw), np.uint8)
            entry, mask = _trigrams(buf, np.cumsum([0, *map(len, raw)]))
            counts[i] = np.bincount(entry[mask], minlength=1 << TABLE_BITS)
        # What one language has seen of an entry backs off to what all have.
        shared = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * counts.shape[1])
        smooth = counts + 50 * shared if len(names) else counts
        return cls(names, np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32) if len(names) else counts)

    def mixtures(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(proportions of each text's chosen languages, zero for others; has it any trigram?)."""
        n, k = len(offsets) - 1, len(self.names)
        out = np.zeros((n, k))
        sizes = np.diff(offsets)
        if not k or not len(buf):
            return out, np.zeros(n, bool)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(n), pieces)
        first = np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = offsets[owner] + (np.arange(len(owner)) - first) * PIECE
        entry, counts = _trigrams(buf, offsets)
        entry = np.where(counts, entry, 1 << TABLE_BITS)
        fit = np.empty((len(at), k))
        for i in range(k):
            fit[:, i] = np.add.reduceat(np.append(self.table[i], np.float32(0))[entry].astype(np.float64), at)
        seen = np.add.reduceat(counts.astype(np.int64), at) > 0
        fit, owner = fit[seen], owner[seen]
        have = np.bincount(owner, minlength=n) > 0
        if not len(fit):
            return out, have
        share, _ = _em(fit, owner, n, np.ones((n, k), bool))
        order = np.argsort(-share, axis=1, kind="stable")
        best = np.full(n, -np.inf)
        penalty = 0.5 * np.log(np.maximum(np.bincount(owner, minlength=n), 2))
        open_ = have.copy()
        for size in range(1, k + 1):
            # A further language whose share is next to nothing cannot pay for itself.
            if size > 1:
                open_ &= share[np.arange(n), order[:, size - 1]] > 0.01
            if not open_.any():
                break
            allowed = np.zeros((n, k), bool)
            np.put_along_axis(allowed, order[:, :size], True, axis=1)
            chosen = open_[owner]
            part, likelihood = _em(fit[chosen], owner[chosen], n, allowed)
            value = np.where(open_, likelihood - size * penalty, -np.inf)
            better = value > best
            out[better], best[better] = part[better], value[better]
        return out, have


def _em(fit: np.ndarray, owner: np.ndarray, n: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages and log-likelihood of each text, from its pieces' log-likelihoods."""
    share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    texts = owner[new]
    pieces = np.diff(np.append(new, len(owner)))
    top = fit.max(1, keepdims=True)
    ratio = np.exp(np.maximum(fit - top, -700))
    if allowed.sum(1).max() > 1:
        for _ in range(ROUNDS):
            belief = ratio * share[owner]
            belief /= np.maximum(belief.sum(1, keepdims=True), 1e-300)
            now = np.add.reduceat(belief, new, axis=0) / pieces[:, None]
            moved = np.abs(now - share[texts]).max()
            share[texts] = now
            if moved < 1e-4:
                break
    piece = np.log(np.maximum((ratio * share[owner]).sum(1), 1e-300)) + top[:, 0]
    likelihood = np.zeros(n)
    likelihood[texts] = np.add.reduceat(piece, new)
    return share, likelihood


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out = np.bincount(owner[_ASCII_LETTER[buf]], minlength=n)[:n] > 0
    wide = np.bincount(owner[buf >= 0x80], minlength=n)[:n] > 0
    for i in np.flatnonzero(wide & ~out):
        out[i] = any(map(str.isalpha, buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def _label(model: Languages, column: pa.Array) -> tuple[list[str], list[float], list[list[str]], list[list[float]]]:
    predicted, scores, sets, shares = [], [], [], []
    buf, at = arrow_bytes(column)
    for a, b in slices(at):
        part, offsets = buf[at[a] : at[b]], at[a : b + 1] - at[a]
        mixture, have = model.mixtures(part, offsets)
        letters = has_letter(part, offsets)
        for i in range(b - a):
            if not letters[i] or not model.names:
                best, ranked = -1, []
            else:
                # A text too short for a trigram says nothing: all languages alike, the first by name.
                row = mixture[i] if have[i] else np.full(len(model.names), 1 / len(model.names))
                ranked = [int(j) for j in np.argsort(-row, kind="stable") if row[j] > 0]
                best = ranked[0]
            predicted.append(model.names[best] if best >= 0 else UNKNOWN)
            scores.append(min(1.0, float(row[best])) if best >= 0 else 0.0)
            sets.append([model.names[j] for j in ranked])
            shares.append([float(row[j]) for j in ranked])
    return predicted, scores, sets, shares


OUT = "doc_id long, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>"
_ARROW_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()),
        ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64())),
    ]
)


def learn_languages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", limit: int = SAMPLE_ROWS
) -> Languages:
    """Fitted on about `limit` labelled rows that are not held out."""
    picked = pick(docs, doc_id=id_column, text=text_column, lang=lang_column)
    return Languages.learn(training_texts(picked, "lang", limit))


def identify(
    docs: DataFrame, model: Languages | None = None, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang"
) -> DataFrame:
    """The languages of each row's whole text.

    Returns doc_id, held_out, lang_pred (the language of the largest share), score (that share), langs and shares (the chosen
    set, largest first). NULL texts and texts without a letter, and all texts where no row has a label: `und`, score 0, no
    languages. Letters too few for a trigram: all languages alike, the first by name. Equal shares: the first by name. Rows
    that repeat each get their row; no rows give none; other columns are ignored.
    """
    model = model or learn_languages(docs, id_column, text_column, lang_column)

    def run(batches):
        for batch in batches:
            columns = _label(model, batch.column("text"))
            arrays = [pa.array(c, t) for c, t in zip(columns, _ARROW_OUT.types[2:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *arrays], schema=_ARROW_OUT)

    rows = pick(docs, doc_id=id_column, text=text_column)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, OUT)


def drop_unknown(
    docs: DataFrame, model: Languages | None = None, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    least: float = LEAST_SHARE,
) -> DataFrame:
    """`docs` without the rows whose text is `und` or has no language of a share of `least` or more in its mixture.

    Texts that say too little for a mixture have all languages alike and so go where there are more than 1 / `least` of them. Where no
    row has a label, all texts with a letter stay. Columns as they are, of whatever names.
    """
    model = model or learn_languages(docs, id_column, text_column, lang_column)
    plain, places = by_place(docs)
    at = int(places[text_column][1:])

    def run(batches):
        for batch in batches:
            if model.names:
                predicted, scores, _, _ = _label(model, batch.column(at))
                keep = [p != UNKNOWN and score >= least for p, score in zip(predicted, scores)]
            else:
                buf, offsets = arrow_bytes(batch.column(at))
                keep = has_letter(buf, offsets)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
