"""Operator 4: licence scan with a positional index of rare words.

Templates are licence texts, short ones and whole ones, each with a phrase that must stand there word for word. The index holds, for
each licence word, the templates and positions it stands at. Document frequencies of all licence words are counted over the whole
corpus. Each file then ranks its own licence words by inverse document frequency over their places in the file: a word the file
repeats often is looked up last. For each template whose phrase words the file holds, all of them, the phrase word of highest rank
in that file is looked up; from its places the template's other words are looked for at the same relative positions, and the place
counts if the whole phrase is there. So no place of a phrase is missed, whatever word leads to it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.bytetext import ALNUM, U64, Sums, arrow_bytes, lower_ascii, slices, word_spans
from studylake.llm.common import materialize, pick
from studylake.llm.licence_texts import WHOLE


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Words of `text` that must all be there, in order and without gaps.
    phrase: str


def template_words(text: str) -> list[str]:
    """Words of a template's text or phrase, by the rule for files."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


#: Phrases whose places are counted, with their labels.
BASE = (
    Template("mit", "mit license", "mit license"),
    Template("apache", "apache license", "apache license"),
    Template("gpl", "general public license", "general public license"),
)
#: Opening or naming sentences of common licences; they add labels and the score.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge",
    ),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("bsd", "licensed under the bsd license", "bsd license"),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("public-domain", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    Template("reserved", "all rights reserved", "all rights reserved"),
    *(Template(*whole) for whole in WHOLE),
)


#: Places that are compared with a template at once.
CANDIDATES = 4096


class Index:
    """Licence words by fingerprint, and each template as numbers of words with the place of its phrase."""

    def __init__(self, base: tuple[Template, ...] = BASE, templates: tuple[Template, ...] = TEMPLATES):
        self.base, self.all = len(base), (*base, *templates)
        texts, phrases = [template_words(t.text) for t in self.all], [template_words(t.phrase) for t in self.all]
        words = sorted({w for text in texts for w in text})
        raw = [w.encode() for w in words]
        buf, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        keys = Sums(buf).spans(at[:-1], at[1:])
        order = np.argsort(keys)
        self.keys, self.words = keys[order], [words[i] for i in order]
        number = {w: i for i, w in enumerate(self.words)}
        self.numbers = [np.array([number[w] for w in text]) for text in texts]
        self.phrases = []
        for own, phrase in zip(texts, phrases):
            self.phrases.append(next((i, i + len(phrase)) for i in range(len(own)) if own[i : i + len(phrase)] == phrase))
        self.rarity = np.zeros(len(self.words))

    def weigh(self, holding: dict[int, int], documents: int) -> None:
        """Inverse document frequency of each licence word."""
        self.rarity = np.array([math.log((documents + 1) / (holding.get(i, 0) + 1)) for i in range(len(self.words))])

    def numbered(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the licence word or -1, text) of each word."""
        text = lower_ascii(buf)
        starts, ends, rows = word_spans(text, offsets, ALNUM)
        # Other than licence words are told by their length first.
        sizes = ends - starts
        fits = np.flatnonzero(np.isin(sizes, np.unique([len(w.encode()) for w in self.words])))
        key = Sums(text).spans(starts[fits], ends[fits])
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        number = np.full(len(starts), -1, np.int32)
        number[fits] = np.where(self.keys[at] == key, at, -1)
        return number, rows

    def places(self, number: np.ndarray, rows: np.ndarray):
        """(template, word index where its phrase starts, share of its words that stand there) for each place of each template."""
        hits = np.flatnonzero(number >= 0)
        by_word = hits[np.argsort(number[hits], kind="stable")]
        edges = np.searchsorted(number[by_word], np.arange(len(self.words) + 1))
        # Each word's files, ascending, with its places in each.
        held = {}
        for w in np.flatnonzero(np.diff(edges)).tolist():
            held[w] = np.unique(rows[by_word[edges[w] : edges[w + 1]]], return_counts=True)
        for t, (words, (a, b)) in enumerate(zip(self.numbers, self.phrases)):
            for at in self._candidates(words[a:b], held, rows, by_word, edges):
                # `at`: where the phrase would start.
                spots = at[:, None] - a + np.arange(len(words))
                inside = (spots >= 0) & (spots < len(number))
                spots = np.clip(spots, 0, len(number) - 1)
                inside &= rows[spots] == rows[np.clip(at, 0, len(number) - 1)][:, None]
                equal = inside & (number[spots] == words)
                found = equal[:, a:b].all(1)
                if found.any():
                    yield t, at[found], equal[found].mean(1)

    def _candidates(self, phrase: np.ndarray, held: dict, rows: np.ndarray, by_word: np.ndarray, edges: np.ndarray):
        """Where a phrase may start, by the word each file with all of its words ranks highest: a bounded number at a time."""
        if any(w not in held for w in phrase.tolist()):
            return
        files = held[phrase[0]][0]
        for w in phrase[1:]:
            files = files[np.isin(files, held[w][0], assume_unique=True)]
        if not len(files):
            return
        rank = np.stack([self.rarity[w] - np.log(held[w][1][np.searchsorted(held[w][0], files)]) for w in phrase])
        chosen = rank.argmax(0)
        for j in np.unique(chosen).tolist():
            at = by_word[edges[phrase[j]] : edges[phrase[j] + 1]]
            at = at[np.isin(rows[at], files[chosen == j])] - j
            for first in range(0, len(at), CANDIDATES):
                yield at[first : first + CANDIDATES]


_ARROW_COUNTS = pa.schema([("word", pa.int32()), ("holding", pa.int64())])
OUT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "place_labels array<string>, place_words array<long>"
)
_ARROW_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("place_labels", pa.list_(pa.string())), ("place_words", pa.list_(pa.int64())),
    ]
)


def _count(index: Index):
    def run(batches):
        total, documents = np.zeros(len(index.words), np.int64), 0
        for batch in batches:
            buf, at = arrow_bytes(batch.column("text"))
            documents += len(at) - 1
            for a, b in slices(at):
                number, rows = index.numbered(buf[at[a] : at[b]], at[a : b + 1] - at[a])
                hit = number >= 0
                pairs = np.unique(rows[hit].astype(np.int64) * len(index.words) + number[hit])
                total += np.bincount(pairs % len(index.words), minlength=len(index.words))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(len(total))], pa.int32()), pa.array([documents, *total.tolist()], pa.int64())], schema=_ARROW_COUNTS
        )

    return run


def licenses(
    docs: DataFrame, base: tuple[Template, ...] = BASE, templates: tuple[Template, ...] = TEMPLATES, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Places of licence phrases in each row's whole text.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word (their smallest and largest start, words
    from 0; NULL without any), base_labels, labels (also of other templates; both distinct, sorted, comma-joined, empty without
    any), score (the largest share of a template's words at a place of its phrase; 0 without any), place_labels and place_words
    (label and start of each place of any template, by start). NULL, empty and wordless texts have no words and no places.
    Overlapping places all count. Rows that repeat each get their row; no rows give none; other columns are ignored.
    """
    index = Index(base, templates)
    rows = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = rows.select("text").mapInArrow(_count(index), "word int, holding long").groupBy("word").agg(F.sum("holding").alias("holding"))
    holding = {r["word"]: r["holding"] for r in materialize(counts, "licence-words").collect()}  # one row for each licence word
    index.weigh(holding, holding.get(-1, 0))

    def run(batches):
        for batch in batches:
            buf, at = arrow_bytes(batch.column("text"))
            out: list[list] = [[] for _ in range(9)]
            for a, b in slices(at):
                for column, values in zip(out, _scan(index, buf[at[a] : at[b]], at[a : b + 1] - at[a])):
                    column += values
            arrays = [pa.array(c, t) for c, t in zip(out, _ARROW_OUT.types[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], schema=_ARROW_OUT)

    return rows.mapInArrow(run, OUT)


def _scan(index: Index, buf: np.ndarray, offsets: np.ndarray) -> list[list]:
    """The columns of `OUT` after doc_id."""
    n = len(offsets) - 1
    number, rows = index.numbered(buf, offsets)
    n_words = np.bincount(rows, minlength=n)
    first = np.cumsum(n_words) - n_words
    places: dict[int, list[tuple[int, str, bool, float]]] = {}
    for t, at, share in index.places(number, rows):
        for w, s in zip(at.tolist(), share.tolist()):
            row = int(rows[w])
            places.setdefault(row, []).append((w - int(first[row]), index.all[t].label, t < index.base, s))
    out: list[list] = [n_words.tolist(), [0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n, [[]] * n, [[]] * n]
    for row, found in places.items():
        found.sort()
        starts = [w for w, _, is_base, _ in found if is_base]
        values = (
            len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x, is_base, _ in found if is_base})),
            ",".join(sorted({x for _, x, _, _ in found})), max(s for *_, s in found), [x for _, x, _, _ in found], [w for w, *_ in found],
        )
        for column, value in zip(out[1:], values):
            column[row] = value
    return out
