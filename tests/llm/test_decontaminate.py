"""Contamination against a plain reading of all windows, and the plan of its main path."""

import hashlib
import random
import re

from studylake.llm.decontaminate import contamination, drop_contaminated
from studylake.llm.queries import ORACLES, QUERIES
from workload.check import compare, connect

DOCS, ITEMS = "doc_id long, text string, words string, item long", "item_id long, text string, window string"


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plainly(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        ids = ",".join(sorted(map(str, found)))
        yield doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_equals_plain_reading(frame):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "é", "日本", "9"]
    text = lambda n: rng.choice([" ", "-", ". "]).join(rng.choice(vocabulary) for _ in range(n))
    passage = text(14)
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 40]))) for i in range(1, 12)]
    items += [(20, None), (21, ""), (22, " .. "), (23, passage), (24, passage), (100, "zz " + passage)]
    docs = [(0, None), (1, ""), (2, "?!"), (3, passage), (4, passage.upper()), (5, (passage + " x ") * 300), (6, passage + " " + passage)]
    docs += [(i, text(rng.randint(1, 60))) for i in range(7, 60)]
    docs += [(i, text(5) + " " + words_text[1] + " " + text(5)) for i, words_text in enumerate(items[:11], 60)]
    out = contamination(
        frame([(d, t, "clash", 1) for d, t in docs], DOCS), frame([(i, t, "clash") for i, t in items], ITEMS)
    ).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out] == list(plainly(docs, items))


def test_repeats_null_ids_and_empty_tables(frame):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = frame([(1, passage, "", 0), (1, "clean text", "", 0), (1, passage, "", 0), (None, passage, "", 0)], DOCS)
    items = frame([(None, passage, ""), (7, passage, ""), (7, passage, "")], ITEMS)
    out = contamination(docs, items).collect()
    assert sorted((r.doc_id or 0, r.n_hit, r.items) for r in out) == [(0, 12, ["7"]), (1, 0, []), (1, 12, ["7"]), (1, 12, ["7"])]
    left = drop_contaminated(docs, items)
    assert left.columns == ["doc_id", "text", "words", "item"] and [r.text for r in left.collect()] == ["clean text"]
    assert contamination(docs.limit(0), items).collect() == []
    assert {r.contaminated for r in contamination(docs, items.limit(0)).collect()} == {False}


def test_every_shared_span_is_found_at_any_offset(frame):
    """Ten shared words and no more, anywhere in a document."""
    rng = random.Random(11)
    shared = [f"s{i}" for i in range(10)]
    docs = [(i, " ".join([f"a{rng.random()}"] * (i % 23) + shared + [f"b{i}"] * (i % 7)), "", 0) for i in range(150)]
    items = frame([(1, " ".join(["p", "q"] + shared + ["r"]), "")], ITEMS)
    assert {r.n_hit for r in contamination(frame(docs, DOCS), items).collect()} == {10}


def test_query_equals_sql_without_python(spark):
    sf_dir = "/root/testdata/sf0.001"
    df = QUERIES["op3_decontamination"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    assert compare(df, connect(sf_dir), ORACLES["op3_decontamination"]) == ""
