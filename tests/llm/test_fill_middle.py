"""Fill-in-the-middle against plain cutting of texts."""

import hashlib
import random

from studylake.llm import fill_middle
from studylake.llm.fill_middle import cut, fill_in_middle, place_of, restore
from studylake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, n long, output string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text, percent=90, spm_percent=20):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return (n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}")


def found(df):
    return [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in df.orderBy("doc_id").collect()]


def texts():
    rng = random.Random(5)
    out = [None, "", "a", "<P>", "x<S>y", "<", "<<<P", "P>S>M>", "é", "日本語のテキスト", "🙂" * 50, "a\0b\r\n" * 9, "<S" * 30 + ">", "word " * 300_000, "é日🙂" * 200_000]
    return out + ["".join(rng.choice("<PSM>é日🙂ab ") for _ in range(rng.randint(0, 40))) for _ in range(400)]


def test_equals_plain_cutting(frame):
    out = fill_in_middle(frame([(i, t, 7, "clash") for i, t in enumerate(texts())], SCHEMA))
    assert found(out) == [plainly(i, t) for i, t in enumerate(texts())]
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}


def test_pieces_make_the_output_and_lead_back(frame):
    given = {i: t or "" for i, t in enumerate(texts())}
    out = fill_in_middle(frame([(i, t, 7, "") for i, t in enumerate(texts())], SCHEMA)).collect()
    for r in out:
        buffers = {"text": given[r.doc_id].encode(), "sentinels": b"<P><S><M>"}
        assert b"".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces) == r.output.encode()
        assert r.output_sha256 == sha(r.output)
        assert r.restored_sha256 == sha(given[r.doc_id])


def test_restore_gives_the_texts(frame):
    out = fill_in_middle(frame([(i, t, 7, "") for i, t in enumerate(texts())], SCHEMA))
    assert {r.doc_id: r.text for r in restore(out).collect()} == {i: t or "" for i, t in enumerate(texts())}


def test_shares_of_the_forms(frame):
    rows = frame([(i, f"text {i}", 0, "") for i in range(4000)], SCHEMA)
    forms = [r.form for r in fill_in_middle(rows).collect()]
    assert 0.07 < forms.count("plain") / 4000 < 0.13 and 0.15 < forms.count("spm") / 4000 < 0.21
    assert {r.form for r in fill_in_middle(rows, percent=100, spm_percent=100).collect()} == {"spm"}
    assert {r.form for r in fill_in_middle(rows, percent=0).collect()} == {"plain"}


def test_null_and_text_ids_repeats_and_no_rows(frame):
    out = fill_in_middle(frame([(None, "some text", 0, "")] * 2, SCHEMA))
    assert found(out) == [plainly(None, "some text")] * 2
    named = fill_in_middle(frame([("a b", "some text")], "doc_id string, text string")).collect()
    assert [(r.doc_id, r.restored_sha256) for r in named] == [("a b", sha("some text"))]
    assert fill_in_middle(frame([], SCHEMA)).collect() == []


def test_cutting_splits_one_piece():
    pieces = [(0, 0, 5), (1, 2, 3)]
    joined = lambda sides: [p for side in sides for p in side]
    for at in range(9):
        left, right = cut(pieces, at)
        assert sum(p[2] for p in left) == at and sum(p[2] for p in joined((left, right))) == 8
    assert cut(pieces, 5) == ([(0, 0, 5)], [(1, 2, 3)])
    assert cut(pieces, 6) == ([(0, 0, 5), (1, 2, 1)], [(1, 3, 2)])


def test_places_across_slices(monkeypatch):
    import numpy as np

    monkeypatch.setattr(fill_middle, "SLICE_BYTES", 4)
    text = "aé日🙂" * 7
    buf = np.frombuffer(text.encode(), np.uint8)
    assert [place_of(buf, i) for i in range(len(text) + 1)] == [len(text[:i].encode()) for i in range(len(text) + 1)]


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op13_fill_in_middle"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, prefix, middle, output = plainly(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, prefix, middle, sha(output))
        assert r.restored_sha256 == sha(docs[r.doc_id] or "")
