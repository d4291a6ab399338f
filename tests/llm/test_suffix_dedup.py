"""Substring removal against a plain reading of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from studylake.llm import suffix_dedup
from studylake.llm.common import split_bytes
from studylake.llm.queries import QUERIES
from studylake.llm.suffix_dedup import difference_cover, remove_repeats

SCHEMA = "doc_id long, text string, chunk string, round int"


def plainly(texts, length):
    raw = [(text or "").encode() for text in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        yield len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def got(df):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize("length", [1, 13, 40, 90, 400, 1000])
def test_every_difference_is_covered(length):
    v, cover = difference_cover(length)
    assert v <= length and {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("length", [5, 40, 120])
def test_equals_plain_reading(frame, length):
    rng = random.Random(length)
    words = ["ab", "éa", "ß", "b a", "cab", "日本", "x"]
    passage = "".join(rng.choice(words) for _ in range(150))
    texts = [None, "", "a", "b" * 300, "b" * 299 + "c", passage, passage, "z" + passage[3:200], passage[50:] + passage[:120]]
    texts += ["".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(30)]
    texts += [texts[-1], texts[-2] + "tail", passage * 3]
    rows = [(i, text, "clash", 7) for i, text in enumerate(texts)]
    assert got(remove_repeats(frame(rows, SCHEMA), length)) == list(plainly(texts, length))


def test_more_buckets_than_partitions(frame, monkeypatch):
    """Buckets grow with the text; each chunk sends few keys to each of them."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 256)
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdé") for _ in range(400))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(400)) + passage[rng.randint(0, 200) :] for _ in range(40)] + [passage] * 20
    assert got(remove_repeats(frame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA), 60)) == list(plainly(texts, 60))


def test_no_table_is_left_in_the_catalog(spark, frame):
    out = remove_repeats(frame([(1, "abc" * 20, "", 0)], SCHEMA), 12)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("suffix_texts")]
    assert out.collect()[0].n_removed == 60


def test_split_bytes(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for text, size in (("16m", 16 << 20), ("134217728b", 128 << 20), ("1g", 1 << 30), ("4096", 4096), ("64KB", 64 << 10)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", text)
            assert split_bytes(spark) == size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_repeated_rows_null_ids_and_no_rows(frame):
    rows = [(None, "q" * 10 + "r" * 30, "", 0)] * 2 + [(1, "s" * 8, "", 0)]
    out = remove_repeats(frame(rows, SCHEMA), 12).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 40), (0, 40), (1, 0)]
    assert [r for r in out if r.doc_id == 1][0].kept == bytearray(b"ssssssss")
    assert remove_repeats(frame([], SCHEMA), 12).collect() == []


def test_one_very_long_text(frame):
    rng = np.random.default_rng(3)
    long = "".join(rng.choice(list("abcdefgh "), 1_500_000))
    rows = [(0, long, "", 0), (1, "t" + long[700_000:700_500] + "u", "", 0), (2, "", "", 0)]
    out = {r.doc_id: r for r in remove_repeats(frame(rows, SCHEMA), 400).collect()}
    assert (out[0].n_removed, out[0].span_starts) == (500, [700_000])
    assert (out[1].n_removed, out[1].span_starts, out[1].span_ends) == (500, [1], [501])


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    out = QUERIES["op1_suffix_dedup"](spark, sf_dir)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert got(out) == list(plainly([d.text for d in docs], 400))
