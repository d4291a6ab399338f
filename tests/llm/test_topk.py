"""Best inner products against all pairs."""

import math
import random

import pytest

from studylake.llm.queries import ORACLES, QUERIES
from studylake.llm.topk import nearest
from workload.check import compare, connect

SCHEMA = "vec_id long, embedding array<float>, key string, cell string"


def plainly(rows, every, k=5, scale=256):
    whole = {i: [math.floor(scale * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in whole:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:k]
            yield from ((q, rank, i, -s) for rank, (s, i) in enumerate(best, 1))


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal", "few", "large"])
def test_equals_all_pairs(frame, kind):
    rng = random.Random(kind)
    n = {"few": 3, "large": 9000}.get(kind, 700)
    centers = [[rng.gauss(0, 3) for _ in range(6)] for _ in range(5)]
    vectors = []
    for i in range(n):
        if kind == "clustered":
            v = [c + rng.gauss(0, 0.05) for c in rng.choice(centers)]
        elif kind == "equal" and i % 3:
            v = [0.5, 0.25, -1.0, 0.0, 2.0, 1.0]
        else:
            v = [rng.gauss(0, 1) for _ in range(6)]
        vectors.append((i, [float(f"{x:.3f}") for x in v]))
    vectors += [(10**6, None), (10**6 + 50, [1.0, None, 0, 0, 0, 0]), (10**6 + 100, [float("nan")] * 6), (10**6 + 150, [float("inf")] * 6)]
    df = frame([(i, v, "clash", "x") for i, v in vectors], SCHEMA)
    stored = [(r.vec_id, r.embedding) for r in df.collect()]
    every = 900 if kind == "large" else 50
    assert sorted(map(tuple, nearest(df, lambda i: i % every == 0).collect())) == sorted(plainly(stored, every))


def test_no_rows_no_queries_and_repeats(frame):
    assert nearest(frame([], SCHEMA), lambda i: i % 50 == 0).collect() == []
    rows = [(1, [1.0, 0.0], "", ""), (2, [0.0, 1.0], "", ""), (None, [1.0, 1.0], "", "")]
    assert nearest(frame(rows, SCHEMA), lambda i: i % 50 == 0).collect() == []


def test_rows_count_one_by_one(frame):
    """Repeated rows, rows of one id, vectors of several lengths: every row but the query's own is a candidate."""
    rng = random.Random(2)
    rows = [(50, [1.0]), (50, [2.0]), (7, [1.0]), (7, [1.0]), (9, [0.5]), (8, [1.0, 2.0]), (50, [1.0]), (100, []), (100, [])]
    rows += [(rng.randrange(120), [float(rng.randint(-3, 3)) for _ in range(rng.randint(1, 3))]) for _ in range(150)] * 2
    rows += [(150, [1.0, 1.0])] * 40
    padded = [(i, [256 * int(x) if x == int(x) else math.floor(256 * x) for x in v] + [0] * (3 - len(v))) for i, v in rows]
    expected = []
    for a, (q, v) in enumerate(padded):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), i) for b, (i, w) in enumerate(padded) if b != a)[:5]
            expected += [(q, rank, i, -score) for rank, (score, i) in enumerate(best, 1)]
    found = nearest(frame([(i, v, "", "") for i, v in rows], SCHEMA), lambda i: i % 50 == 0)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_hot_query_cells_are_cut(frame, monkeypatch):
    from studylake.llm import topk

    monkeypatch.setattr(topk, "PART", 64)
    rng = random.Random(9)
    rows = [(i, [round(rng.gauss(0, 1), 3) for _ in range(4)] if i % 3 else [1.0, 2.0, 3.0, 4.0], "", "") for i in range(900)]
    stored = [(r.vec_id, r.embedding) for r in frame(rows, SCHEMA).collect()]
    assert sorted(map(tuple, nearest(frame(rows, SCHEMA), lambda i: i % 2 == 0).collect())) == sorted(plainly(stored, 2))


def test_scores_that_would_not_be_exact_are_refused(frame):
    with pytest.raises(ValueError, match="not be exact"):
        nearest(frame([(0, [3e5] * 2, "", ""), (1, [1.0, 1.0], "", "")], SCHEMA), lambda i: i % 50 == 0)
    fits = nearest(frame([(0, [2e5] * 2, "", ""), (1, [2e5, 1.0], "", "")], SCHEMA), lambda i: i % 50 == 0).collect()
    assert [r.score for r in fits] == [(256 * 200_000) ** 2 + 256 * 200_000 * 256]


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert compare(QUERIES["op7_knn_join"](spark, sf_dir), connect(sf_dir), ORACLES["op7_knn_join"]) == ""
