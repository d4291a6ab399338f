"""The pipeline stage by stage against plain readings, on whole tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from studylake.llm.languages import identify, learn_languages
from studylake.llm.queries import QUERIES
from tests.llm.test_decontaminate import plainly as contaminated
from tests.llm.test_line_dedup import often
from tests.llm.test_mixing import wanted
from tests.llm.test_near_dedup import plainly as near

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
ODD = [
    (9001, None, "en", "src0", None), (9002, "", "en", "src0", 0), (9003, "12 ## 34", None, None, 8), (9004, "é", "fr", None, 1),
    (9005, "some words that stand here alone", "en", "src1", 32), (9005, "some words that stand here alone", "en", "src1", 32),
    (None, "another row without any id at all", None, "src1", 33),
]
ODD += [(9100 + i, f"The line of this site\nand what only number {i} says, {'x' * i}", "en", "src0", 50 + i) for i in range(8)]
ODD += [(9200, "The line of this site", "en", "src0", 21)]


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.unionByName(spark.createDataFrame(ODD, docs.schema))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_each_stage_equals_a_plain_reading(spark, documents):
    docs = documents.collect()
    columns = documents.columns

    got = STAGES["language_id"](spark, documents, SF)
    assert got.columns == columns
    # The mixtures of the query itself; its labels are those of the stage, whose input is the same.
    order = documents.withColumn("text", F.coalesce("text", F.lit("")))
    shares = {}
    for r in identify(order.withColumn("n", F.xxhash64("text")).withColumn("doc_id", F.col("n")), model=learn_languages(documents)).collect():
        shares[r.doc_id] = (r.lang_pred, max(r.shares, default=0))
    known = {r.text: shares[r.n] for r in order.select("text", F.xxhash64("text").alias("n")).distinct().collect()}
    expected = [tuple(r) for r in docs if known[r.text or ""][0] != "und" and known[r.text or ""][1] >= 0.5]
    assert rows_of(got) == sorted(expected, key=str)
    assert len(expected) < sum(any(c.isalpha() for c in r.text or "") for r in docs) < len(docs)

    got = STAGES["line_dedup"](spark, documents, SF)
    assert got.columns == columns
    lines = [(r.source, (r.text or "").split("\n")) for r in docs]
    gone, expected = often(lines), []
    assert gone
    for r, (source, own) in zip(docs, lines):
        kept = [x for x in own if (source, x) not in gone]
        if len(kept) == len(own):
            expected.append(tuple(r))
        elif any(x.strip(" ") for x in kept):
            expected.append((r.doc_id, "\n".join(kept), r.lang, r.source, len("\n".join(kept))))
    assert rows_of(got) == sorted(expected, key=str)

    got = STAGES["near_dedup"](spark, documents, SF)
    assert got.columns == columns
    order = sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    found = near([r.text for r in order], 5)
    expected = [tuple(r) for i, (r, (n, root)) in enumerate(zip(order, found)) if root == i or not n]
    assert rows_of(got) == sorted(expected, key=str)

    got = STAGES["decontamination"](spark, documents, SF)
    assert got.columns == columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = [x[-1] for x in contaminated([(r.doc_id, r.text) for r in docs], items)]
    assert any(bad)
    assert rows_of(got) == sorted((tuple(r) for r, b in zip(docs, bad) if not b), key=str)

    got = STAGES["mixing"](spark, documents, SF)
    assert got.columns == [*columns, "mix_size", "mix_target", "mix_taken", "mix_copies"]
    sizes, taken = {}, {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    target = wanted(sizes)
    for r in got.collect():
        assert r.mix_target == pytest.approx(target[r.source]) and 0 < r.mix_taken <= 3 * r.mix_size
        taken[r.source] = taken.get(r.source, 0) + r.mix_taken
    assert all(abs(taken.get(s, 0) - t) <= 0.51 for s, t in target.items())


def test_pipeline_applies_its_stages(spark):
    out = QUERIES["pipeline"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert rows_of(out) == rows_of(docs) and out.count() > 0


def test_stages_on_no_documents(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
