"""Near duplicates against all pairs on small tables; components against a plain search."""

import random
import re
from collections import defaultdict

import pytest

from studylake.llm.components import components
from studylake.llm.near_dedup import keep_one, near_duplicates
from studylake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, node string, class long"


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plainly(texts, size, percent=80):
    sets = [shingles(t, size) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for h in holders.values() if len(h) < 400 for a in h for b in h if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return [(len(s), r) for s, r in zip(sets, roots(len(texts), links))]


def family(rng, base, n, most):
    for _ in range(n):
        words = base[:]
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("size", [4, 5])
def test_equals_all_pairs(frame, size):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [None, "", "  \n", "One", "one", "a b c", "A B\tC", "a b c d"]
    base = [rng.choice(vocabulary) for _ in range(150)]
    # A family whose members lie on both sides of the threshold, more than one block, and a chain of small steps.
    texts += family(rng, base, 300, 9)
    chain = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(12):
        texts.append(" ".join(chain))
        chain[(i * 37) % 120] = f"step{i}"
        chain[(i * 53 + 20) % 120] = f"also{i}"
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    out = near_duplicates(frame(rows, SCHEMA), size).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in out] == plainly(texts, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_repeats_null_ids_and_no_rows(frame):
    rows = [(5, "a b c d e f", "", 0), (5, "a b c d e f", "", 0), (None, "a b c d e f", "", 0), (3, "A b c d e f", "", 0), (None, None, "", 0)]
    out = near_duplicates(frame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [
        (-1, -1, True), (-1, 3, False), (3, 3, True), (5, 3, False), (5, 3, False),
    ]
    assert near_duplicates(frame([], SCHEMA)).collect() == []
    kept = keep_one(frame(rows + [(7, "", "x", 1)] * 2, SCHEMA))
    assert kept.columns == ["doc_id", "text", "node", "class"]
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, ""), (-1, "a b c d e f"), (7, ""), (7, "")]
    assert keep_one(frame([], SCHEMA)).collect() == []


def test_one_of_equal_rows_stays(frame):
    rows = [(1, "some words that repeat here", "", 0)] * 3 + [(2, "other words that stay here too", "", 0)]
    assert sorted(r.doc_id for r in keep_one(frame(rows, SCHEMA)).collect()) == [1, 2]


@pytest.mark.parametrize("seed", range(2))
def test_components(frame, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    found = dict(map(tuple, components(frame([*links, (None, 3)], "a long, b long")).collect()))
    expected = roots(400, links)
    assert found == {x: expected[x] for link in links for x in link}
    assert components(frame([], "a long, b long")).collect() == []


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    out = QUERIES["op5_minhash_dedup"](spark, sf_dir).orderBy("doc_id").collect()
    assert [(r.n_shingles, docs.index(next(d for d in docs if d.doc_id == r.component_id))) for r in out] == plainly([d.text for d in docs], 4)
