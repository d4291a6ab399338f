"""Licence places against a plain reading."""

import random
import re

import numpy as np

from studylake.llm.bytetext import arrow_bytes
from studylake.llm.licence_texts import WHOLE
from studylake.llm.licenses import BASE, TEMPLATES, Index, Template, licenses
from studylake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, n_words long, labels string"


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def places(words, phrase):
    phrase = words_of(phrase)
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def plainly(text):
    words = words_of(text)
    found = [(i, t.label) for t in BASE for i in places(words, t.phrase)]
    starts = [i for i, _ in found]
    base = {x for _, x in found}
    more = {t.label for t in TEMPLATES if places(words, t.phrase)}
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)),
    )


def found(df):
    return [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in df.orderBy("doc_id").collect()]


def test_equals_plain_reading(frame):
    rng = random.Random(2)
    vocabulary = sorted({w for t in TEMPLATES for w in words_of(t.text)}) + ["É", "x1"]
    texts = [None, "", "?!", "MIT License", "mit-license MIT\nLICENSE mit", "GNU General Public License general public license", "Mit Lizenz", "license mit"]
    texts += [t.text for t in TEMPLATES] + ["mit license " * 20_000, "general public", "the apache LICENSE, Version 2.0 or the MIT license"]
    for _ in range(200):
        texts.append(rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))))
        texts.append(" ".join(rng.sample(vocabulary, 5)) + " " + rng.choice([*BASE, *TEMPLATES]).text + " and")
    out = licenses(frame([(i, t, 9, "clash") for i, t in enumerate(texts)], SCHEMA))
    assert found(out) == [plainly(t) for t in texts]
    scores = {r.doc_id: (r.score, r.labels) for r in out.collect()}
    assert all(0 <= s <= 1 and (s > 0) == bool(labels) for s, labels in scores.values())
    assert all(scores[8 + i][0] == 1 for i in range(len(TEMPLATES)))


def test_repeats_null_ids_and_no_rows(frame):
    out = licenses(frame([(None, "MIT License", 0, "")] * 2, SCHEMA)).collect()
    assert [(r.doc_id, r.n_base, r.place_labels, r.place_words) for r in out] == [(None, 1, ["mit", "mit"], [0, 0])] * 2
    assert licenses(frame([], SCHEMA)).collect() == []


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    out = QUERIES["op4_license_scan"](spark, sf_dir)
    assert found(out) == [plainly(d.text) for d in docs]
    assert any(r.n_base for r in out.collect())


def test_each_file_looks_up_the_word_it_holds_least(monkeypatch):
    import pyarrow as pa

    index = Index((Template("x", "mit license", "mit license"),), ())
    texts = ["mit " * 50 + "license", "license " * 50 + "mit license", "mit mit mit", "license mit license mit"]
    buf, at = arrow_bytes(pa.array(texts))
    number, rows = index.numbered(buf, at)
    # Both words are equally rare in the corpus, so the places in the file decide.
    index.weigh({i: 4 for i in range(len(index.words))}, 4)
    looked_up = []
    candidates = index._candidates
    monkeypatch.setattr(index, "_candidates", lambda *given: (looked_up.append(c) or c for c in candidates(*given)))
    found = {int(rows[w]): int(w - np.searchsorted(rows, rows[w])) for _, ws, _ in index.places(number, rows) for w in ws}
    assert found == {0: 49, 1: 50, 3: 1}
    # One place of `license` in the first file, one of `mit` in the second, two of either in the last; the third lacks a word.
    assert sum(map(len, looked_up)) == 4


def test_whole_texts(frame):
    rows = [(i, "Copyright 2020 somebody\n\n" + text, 0, "") for i, (_, text, _) in enumerate(WHOLE)]
    # A text cut after its first two thirds is known by its phrase if that is there, with a smaller share of its words.
    cut = words_of(WHOLE[0][1])[:100]
    out = licenses(frame([*rows, (len(rows), " ".join(cut), 0, "")], SCHEMA), templates=tuple(Template(*w) for w in WHOLE)).orderBy("doc_id").collect()
    for r, (label, _, _) in zip(out, WHOLE):
        assert label in r.labels.split(",") and r.score == 1
    assert out[-1].labels == "mit" and abs(out[-1].score - len(cut) / len(words_of(WHOLE[0][1]))) < 1e-12
