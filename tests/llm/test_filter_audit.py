"""Filter interactions against plain counting of every order."""

import itertools
import random
import re

from studylake.llm.filter_audit import filter_audit, interactions
from studylake.llm.queries import QUERIES

DOCS = "doc_id long, text string, source string, mask long, part string, n_chars long"
LABELS = "doc_id long, quality int, toxic int, n long"


def fails_of(text, words):
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }


def plainly(docs, labels):
    """{(part, order, step): figures} of rows (doc_id, text, source) and (doc_id, quality, toxic)."""
    least = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = {}
    for doc_id, text, source in docs:
        text = text or ""
        fails = fails_of(text, [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w])
        fails["E"] = doc_id is not None and doc_id > least[text]
        rows.setdefault(source or "", []).append(({x for x in fails if fails[x]}, doc_id in good, doc_id in toxic))
    out, shapley = {}, {}
    for part, own in rows.items():
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[0]]
                left = [r for r in left if letter not in r[0]]
                failing = sum(letter in r[0] for r in own)
                alone = sum(r[0] == {letter} for r in own)
                figures = (len(left), len(gone), failing - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone))
                out[part, "".join(order), step] = figures
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return {key: (*figures, shapley[key[0], key[1][key[2] - 1]]) for key, figures in out.items()}


def found(df):
    rows = df.collect()
    out = {
        (r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows
    }
    assert len(out) == len(rows)
    return out


def random_docs(n, rng):
    pool = [None, "", " \t\r\n\x0b\x0c", "A", "#", "a b c", "É" * 30, "word " * 60, "word " * 49 + "x", "x" * 3_000_000]
    for _ in range(25):
        words = [rng.choice(["alpha", "Beta", "GAMMA", "δ", "x|y", "50%", "one", "two", "three", f"w{rng.random()}"]) for _ in range(rng.randint(1, 120))]
        pool.append(rng.choice([" ", "\n", "\t "]).join(words))
    return [(rng.choice([None, *range(n)]), rng.choice(pool), rng.choice([None, "", "a", "a", "a", "b"])) for _ in range(n)]


def test_equals_plain_counting(frame):
    rng = random.Random(11)
    docs = random_docs(300, rng)
    labels = [(rng.choice([None, *range(300)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(250)]
    out = filter_audit(frame([(*d, 1, "clash", 2) for d in docs], DOCS), frame([(*x, 0) for x in labels], LABELS))
    assert found(out) == plainly(docs, labels)


def test_a_third_of_all_rows_are_copies(frame):
    docs = [(i, "same text" if i % 3 == 0 else f"text {i}", "hot" if i % 5 else f"s{i % 7}") for i in range(3000)]
    labels = [(i, 1, 1) for i in range(0, 3000, 2)]
    out = filter_audit(frame([(*d, 1, "", 2) for d in docs], DOCS), frame([(*x, 0) for x in labels], LABELS))
    assert found(out) == plainly(docs, labels)


def test_no_rows_and_no_labels(frame):
    none = frame([], LABELS)
    assert filter_audit(frame([], DOCS), none).collect() == []
    out = found(filter_audit(frame([(1, "a", None, 1, "", 2)], DOCS), none))
    assert out == plainly([(1, "a", None)], [])
    assert len(out) == 600


def test_many_parts_are_whole(spark):
    """More rows than a recursive query returns by default."""
    cells = spark.range(4000).selectExpr("CAST(id AS STRING) AS part", "CAST(id % 8 AS INT) AS mask", "id AS n", "0L AS good", "1L AS toxic")
    out = interactions(cells, "ABCDE")
    assert out.count() == 4000 * 600
    row = out.where("part = '9' AND filter_order = 'BADCE' AND step = 2").collect()[0]
    assert (row.kept, row.removed, row.redundant, row.unique_fails, row.toxic_lost) == (0, 9, 0, 9, 1)


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    assert found(QUERIES["op11_filter_audit"](spark, sf_dir)) == plainly(docs, labels)
