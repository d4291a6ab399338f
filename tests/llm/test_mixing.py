"""Targets, rates and copies against plain arithmetic."""

import random
import re

import pytest

from studylake.llm.mixing import balance, mix, mixed
from studylake.llm.queries import ORACLES, QUERIES
from workload.check import compare, connect

SCHEMA = "doc_id long, text string, source string, size string, target long"


def wanted(sizes, weights=(5, 2, 1), most=3):
    """sizes: (source, words). Share by weight, cut, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, done = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in done]
        rest = total - sum(done.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s: most * sizes[s] for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return done | share
        done |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_words_taken(frame, seed):
    rng = random.Random(seed)
    names = ["a", "B", "é", "z", "", None, "日", "10", "9"][: 4 + 2 * seed]
    rows = []
    for i in range(600):
        source = names[0] if i % 3 == 0 else rng.choice(names)
        words = rng.choice([0, 1, 3, 40, 400]) if source != "z" else 2
        rows.append((i, None if i % 97 == 0 else " \t".join(["Wörd"] * words), source, "clash", 1))
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    expected = wanted(sizes)
    out = mix(frame(rows, SCHEMA)).collect()
    again = mix(frame(rows, SCHEMA)).collect()
    assert sorted(out) == sorted(again) and len(out) == 600
    source_of, took = {r[0]: r[2] for r in rows}, dict.fromkeys(sizes, 0)
    for r in out:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(expected[s], rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size and r.copies == (r.taken // r.size if r.size else 0)
        took[s] += r.taken
    assert all(abs(took[s] - expected[s]) <= 0.51 for s in sizes)
    # Whole copies, but for one document a source at most; a source's documents differ by one copy at most.
    for s in sizes:
        own = [r for r in out if source_of[r.doc_id] == s and r.size]
        assert sum(r.taken % r.size > 0 for r in own) <= 1
        assert len({r.copies for r in own}) <= 2


def test_whole_texts_of_a_source_below_its_size(frame):
    """A rate below 1 takes whole documents, of all sizes, and none of the others."""
    rows = [(i, f"{i} " + "w " * (i % 50), "big" if i % 10 else "small", "", 0) for i in range(4000)]
    out = mix(frame(rows, SCHEMA)).collect()
    big = [r for r in out if r.rate < 1]
    assert big and sum(r.taken not in (0, r.size) for r in big) == 1
    share = sum(r.taken for r in big) / sum(r.size for r in big)
    longer, shorter = ([r for r in big if (r.size > 25) == side] for side in (True, False))
    assert all(abs(sum(r.taken > 0 for r in part) / len(part) - share) < 0.1 for part in (longer, shorter))


def test_repeated_rows_are_taken_one_by_one(frame):
    rows = [(1, "a b c", "x", "", 0)] * 900 + [(None, "d e", "x", "", 0)] * 300 + [(i, "w", "y", "", 0) for i in range(5)]
    out = mix(frame(rows, SCHEMA)).collect()
    x = [r for r in out if r.size > 1]
    assert sum(r.taken for r in x) == round(x[0].target) and sum(r.taken % r.size > 0 for r in x) <= 1


def test_newton_reaches_any_rate(frame):
    rows = [("a", 1000, 3000.0), ("b", 10**9, 1.0), ("c", 7, 7.0), ("d", 0, 0.0), ("e", 10, 0.0), (None, 3, 8.9)]
    out = {r.source: r for r in balance(frame(rows, "source string, source_size long, target double")).collect()}
    assert out["d"].rate == out["e"].rate == 0
    for s in ("a", "b", "c", None):
        assert out[s].rate * out[s].source_size == pytest.approx(out[s].target, rel=1e-12)


def test_empty_tables_and_columns(frame):
    assert mix(frame([], SCHEMA)).collect() == []
    assert [(r.size, r.taken, r.target) for r in mix(frame([(None, None, None, "", 0), (1, " ", None, "", 0)], SCHEMA)).collect()] == [(0, 0, 0.0)] * 2
    out = mixed(frame([(1, "a b", "s", "clash", 4), (2, "", "s", "x", 5)], SCHEMA))
    assert out.columns == ["doc_id", "text", "source", "size", "target", "mix_size", "mix_target", "mix_taken", "mix_copies"]
    assert [tuple(r) for r in out.collect()] == [(1, "a b", "s", "clash", 4, 2, 2.0, 2, 1)]


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert compare(QUERIES["op6_mixing"](spark, sf_dir), connect(sf_dir), ORACLES["op6_mixing"]) == ""
