"""Language, toxicity and quality: held-out accuracy, exact parts against plain ones, and edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from studylake.llm.languages import Languages, drop_unknown, identify
from studylake.llm.quality import VOCABULARY, WIDTH, index_vectors, quality, tokens, word_vectors
from studylake.llm.queries import QUERIES
from studylake.llm.samples import held_out, labelled_texts, training_texts
from studylake.llm.toxicity import EDGES, Field, Toxicity, _spaced, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score double, held_out string"
LABELS = "doc_id long, toxic int, quality int, text string"


@pytest.fixture(scope="module")
def truth(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return docs, labels


def out_of_fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_held_out_rows(spark):
    got = {r["id"]: r["h"] for r in spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: out_of_fold(i) for i in range(200)}


def test_language_accuracy(spark, truth):
    out = QUERIES["op9_language_id"](spark, SF).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(truth[0]) and all(r.held_out == out_of_fold(r.doc_id) and 0 <= r.score <= 1 for r in out)
    assert np.mean([truth[0][r.doc_id].lang == r.lang_pred for r in held]) > 0.98


def test_toxicity_accuracy(spark, truth):
    out = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, SF).collect()}
    held = [(out[i], label.toxic) for i, label in truth[1].items() if out[i].held_out]
    assert len(out) == len(truth[0]) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    assert np.mean([r.predicted == y for r, y in held]) > 0.95
    assert sum(r.predicted for r, y in held if not y) <= 1


def test_quality_accuracy(spark, truth):
    out = {r.doc_id: r for r in QUERIES["op10_quality"](spark, SF).collect()}
    held = [(out[i], label.quality) for i, label in truth[1].items() if out[i].held_out]
    assert len(out) == len(truth[0]) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert np.mean([r.predicted == y for r, y in held]) > 0.97


ROWS = [
    (0, None, "aa", 0.0, ""), (1, "", "aa", 0.0, ""), (2, "12 .. ##", "bb", 0.0, ""), (3, "É", None, 0.0, ""), (4, "日本語", "bb", 0.0, ""),
    (None, "ab ba ab", None, 0.0, ""), (5, "x" * 200_000 + " ab", "aa", 0.0, ""), (6, "ab ba ab ba abab baba", "aa", 0.0, ""),
    (6, "ab ba ab ba abab baba", "aa", 0.0, ""), (7, "cd dc cd dc cdcd dcdc", "bb", 0.0, ""), (9, "cdcd dcdc dcd", None, 0.0, ""),
]


def test_languages_of_odd_texts(frame):
    out = [tuple(r)[:4] for r in identify(frame(ROWS, DOCS)).orderBy("doc_id", "lang_pred").collect()]
    assert len(out) == len(ROWS)
    by_id = {r[0]: r for r in out}
    assert all(by_id[i][2:] == ("und", 0.0) for i in (0, 1, 2)) and all(by_id[i][2] in ("aa", "bb") for i in (3, 4, 5, 9, None))
    left = drop_unknown(frame(ROWS, DOCS))
    assert left.columns == ["doc_id", "text", "lang", "score", "held_out"] and left.count() == len(ROWS) - 3
    # Without any label there is nothing to learn.
    bare = frame([(r[0], r[1], None, 0.0, "") for r in ROWS], DOCS)
    assert {(r.lang_pred, r.score) for r in identify(bare).collect()} == {("und", 0.0)}
    assert drop_unknown(bare).count() == len(ROWS) - 3
    assert identify(frame([], DOCS)).collect() == [] and drop_unknown(frame([], DOCS)).collect() == []


def test_mixtures_find_both_languages():
    rng = np.random.default_rng(1)
    make = lambda letters, n: " ".join("".join(rng.choice(list(letters), 6)) for _ in range(n))
    model = Languages.learn([(make("abcde", 400), "one"), (make("vwxyz", 400), "two"), (make("klmno", 400), "three")])
    texts = [make("abcde", 90), make("abcde", 60) + " " + make("vwxyz", 30), make("klmno", 45) + " " + make("vwxyz", 45)]
    raw = [t.encode() for t in texts]
    share, have = model.mixtures(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    one, three, two = 0, 1, 2
    assert have.all() and np.allclose(share.sum(1), 1)
    assert share[0, one] > 0.99 and abs(share[1, one] - 2 / 3) < 0.1 and abs(share[2, three] - 0.5) < 0.1 and share[2, one] == 0 and share[1, three] == 0


@pytest.mark.parametrize("seed", range(4))
def test_marginals_equal_plain_forward_backward(seed):
    rng = np.random.default_rng(seed)
    field = Field(np.stack((np.zeros(len(EDGES) + 1), rng.normal(0, 3, len(EDGES) + 1)), 1), rng.normal(0, 1.5, (2, 2)))
    texts = [rng.integers(0, len(EDGES) + 1, n) * (rng.random(n) < rng.choice([0.05, 0.5, 1.0])) for n in (1, 2, 3, 17, 60, 400)]
    expected = []
    for bins in texts:
        e, m = np.exp(field.emit), np.exp(field.move)
        forward, backward = np.ones((len(bins), 2)), np.ones((len(bins), 2))
        for t, x in enumerate(bins):
            state = e[x] * (forward[t - 1] @ m if t else 1)
            forward[t] = state / state.sum()
        for t in range(len(bins) - 2, -1, -1):
            state = m @ (e[bins[t + 1]] * backward[t + 1])
            backward[t] = state / state.sum()
        both = forward * backward
        expected.append((both[:, 1] / both.sum(1))[bins > 0])
    at = [np.flatnonzero(b) for b in texts]
    doc = np.repeat(np.arange(len(texts)), [len(a) for a in at])
    got = field.marginals(np.concatenate([b[b > 0] for b in texts]), np.concatenate(at), doc, np.array([len(b) for b in texts]))
    assert np.allclose(got, np.concatenate(expected), atol=1e-9)


def test_toxic_spans_and_odd_texts(frame):
    rng = np.random.default_rng(4)
    plain = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 300, n))
    rows = [(i, plain(30) + (" Nasty nastier, rude " if i % 3 == 0 else " ") + plain(20), "", 0.0, "") for i in range(300)]
    labels = [(i, int(i % 3 == 0), 1, "") for i in range(300)] + [(5000, 1, 0, ""), (None, 1, 1, ""), (7, None, None, "")]
    odd = [(1000, None, "", 0.0, ""), (1001, "", "", 0.0, ""), (1002, "..", "", 0.0, ""), (None, "é nasty rude", "", 0.0, ""), (1003, "w1 " * 50_000, "", 0.0, "")]
    out = toxicity(frame(rows + odd, DOCS), frame(labels, LABELS)).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == 305 and all(by_id[i].predicted == (i % 3 == 0) for i in range(300))
    assert all(by_id[i].predicted == 0 and by_id[i].span_starts == [] for i in (1000, 1001, 1002, 1003))
    assert (by_id[None].span_starts, by_id[None].span_ends) == ([3], [13])
    none = toxicity(frame(odd, DOCS), frame([], LABELS)).collect()
    assert all(r.score < 0.01 for r in none) and toxicity(frame([], DOCS), frame(labels, LABELS)).collect() == []


def test_field_learns_from_late_texts(monkeypatch):
    rows = [(f"{c}{i} " + " ".join(f"{c}{i}w{j}" for j in range(80)) + " vile" * (i % 2), i % 2) for c in "az" for i in range(60)]
    rows.sort()
    seen, fit = [], Field.fit.__func__

    def watch(cls, bins, states, starts):
        seen.append((len(starts), bins, states))
        return fit(cls, bins, states, starts)

    monkeypatch.setattr("studylake.llm.toxicity.SEQUENCES", 10**6)
    monkeypatch.setattr(Field, "fit", classmethod(watch))
    Toxicity.learn(rows)
    limit = seen[0][0] // 4
    monkeypatch.setattr("studylake.llm.toxicity.SEQUENCES", limit)
    numbered = []
    monkeypatch.setattr("studylake.llm.toxicity._spaced", lambda used, n, own=_spaced: numbered.append((used, own(used, n))) or own(used, n))
    Toxicity.learn(rows)
    (used, chosen), = numbered
    at, last = np.flatnonzero(chosen), np.flatnonzero(used)[-1]
    assert seen[1][0] == limit == len(at) and used[at].all() and at[-1] == last and (at > last / 2).sum() >= limit // 3


def test_quality_of_odd_texts(frame):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{x}" + ("###" if i % 4 == 0 else "") for x in rng.integers(0, 90, 40)), "", 0.0, "") for i in range(240)]
    labels = [(i, 0, int(i % 4 != 0), "") for i in range(240)] + [(None, 1, 1, ""), (3, None, None, "")]
    odd = [(1000, None, "", 0.0, ""), (1001, "", "", 0.0, ""), (1002, " \n", "", 0.0, ""), (None, "é", "", 0.0, ""), (1003, "w1 " * 50_000, "", 0.0, "")]
    out = {r.doc_id: r for r in quality(frame(rows + odd, DOCS), frame(labels, LABELS)).collect()}
    assert np.mean([out[i].predicted == (i % 4 != 0) for i in range(240)]) > 0.97
    assert len(out) == 245 and out[1000].score == out[1001].score == out[1002].score
    assert {r.score for r in quality(frame(odd, DOCS), frame([], LABELS)).collect()} == {0.5}
    assert quality(frame([], DOCS), frame(labels, LABELS)).collect() == []


def test_context_sums_equal_plain_loop(frame):
    texts = ["a b c, d e", "b a", None, "", "x", "a b c, d e"]
    columns, signs = index_vectors()
    total = np.zeros((VOCABULARY, WIDTH))
    for text in texts:
        raw = (text or "").encode()
        row, _, _ = tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for i in range(len(row)):
            for j in range(max(0, i - 2), min(len(row), i + 3)):
                if i != j:
                    np.add.at(total[row[i]], columns[row[j]], signs[row[j]])
    expected = np.sign(total) * np.log1p(np.abs(total))
    used = np.abs(expected).sum(1) > 0
    expected[used] -= expected[used].mean(0)
    length = np.linalg.norm(expected, axis=1, keepdims=True)
    expected = np.divide(expected, length, out=np.zeros_like(expected), where=length > 0)
    got = word_vectors(frame([(i, t, "", 0.0, "") for i, t in enumerate(texts)], DOCS).repartition(3))
    assert np.allclose(got, expected, atol=1e-5)


def test_samples_are_bounded_and_leave_held_out_rows_alone(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text", "if(id % 7 = 0, null, 'aa') AS lang")
    sample = training_texts(docs, "lang", 500)
    assert 400 < len(sample) <= 1000 and not any(out_of_fold(int(t[1:])) or int(t[1:]) % 7 == 0 for t, _ in sample)
    assert sample == training_texts(docs.repartition(5), "lang", 500)
    labels = docs.selectExpr("doc_id", "1 AS toxic").union(docs.selectExpr("doc_id", "1"))
    both = labelled_texts(docs, labels, "toxic", 100)
    assert 60 < len(both) <= 200 and not any(out_of_fold(int(t[1:])) for t, _ in both)


def test_rare_labels_are_sampled_whole(spark):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('t', id) AS text", "if(id % 6000 = 0, 'zz', if(id % 2 = 0, 'aa', 'bb')) AS lang")
    sample = training_texts(docs, "lang", 400)
    count = {lang: sum(x == lang for _, x in sample) for lang in ("aa", "bb", "zz")}
    rare = [i for i in range(0, 60_000, 6000) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(t for t, lang in sample if lang == "zz") == sorted(f"t{i}" for i in rare)
    assert 80 <= count["aa"] <= 200 and 80 <= count["bb"] <= 200
    assert sample == training_texts(docs.repartition(5), "lang", 400)
