"""Recurring lines of sites against a plain count."""

import random
from collections import Counter, defaultdict

from studylake.llm.line_dedup import drop_lines, page_lines
from studylake.llm.near_dedup import keep_one
from studylake.llm.queries import ORACLES, QUERIES
from workload.check import compare, connect

PAGES = "page_id long, url string, html string, site string, lines long"
DOCS = "doc_id long, text string, source string, n_chars long, site string, kept string"


def often(rows, ratio=0.3, least=3):
    pages, holding = Counter(s for s, _ in rows), Counter((s, x) for s, lines in rows for x in {y for y in lines if y.strip(" ")})
    return {k for k, n in holding.items() if n >= least and n > ratio * pages[k[0]]}


def test_pages_equal_plain_count(frame):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        host = rng.choice(["a.example", "a.example", "a.example", "b.example", f"c{i}.example"])
        parts = ["<p>Menu</p>", f"<p>only {i}</p>", "<!-- x\ny --><b> Footer </b>", "<script>if (a<b) {}</script>"]
        parts += [f"<i>sometimes {rng.randrange(5)}</i>"] + ["<p>twice</p>"] * 2 * (i % 4 == 0) + ["<br>  <br>"]
        rows.append((i, f"http://{host}/p/{i}?q#f", "<body>" + "".join(parts), "clash", 9))
    rows += [(500, None, "x<br>y", "", 0), (501, "nothing", "x", "", 0), (502, "http://a.example", None, "", 0), (503, "http://a.example", "", "", 0)]
    expected_lines = {}
    for r in rows:
        html = (r[2] or "").replace("<script>if (a<b) {}</script>", "<s>").replace("<!-- x\ny -->", "<s>")
        pieces = [p.split(">")[-1].strip(" ") for p in html.split("<")] if "<" in html else [html]
        expected_lines[r[0]] = [p for p in pieces if p]
    host = {r[0]: r[1].split("/")[2] if r[1] and "//" in r[1] else "" for r in rows}
    gone = often([(host[i], x) for i, x in expected_lines.items()])
    assert gone
    out = {r.page_id: r for r in page_lines(frame(rows, PAGES)).collect()}
    for i, lines in expected_lines.items():
        kept = [x for x in lines if (host[i], x) not in gone]
        assert (out[i].host, out[i].n_lines, out[i].n_dropped, out[i].text) == (host[i], len(lines), len(lines) - len(kept), "\n".join(kept))


def test_documents_keep_columns(frame):
    rows = [(i, f"head\n\nown {i}\ntail", "s", 0, "x", "y") for i in range(10)]
    rows += [(20, "head", "s", 4, "", ""), (21, None, "s", None, "", ""), (22, "", None, 0, "", ""), (23, "head\nz", "t", 6, "", "")]
    out = drop_lines(frame(rows, DOCS), ratio=0.5)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "site", "kept"]
    found = {r.doc_id: tuple(r) for r in out.collect()}
    assert found[3] == (3, "\nown 3", "s", 6, "x", "y")
    assert 20 not in found and found[21][1] is None and found[22][1] == "" and found[23] == (23, "head\nz", "t", 6, "", "")
    assert drop_lines(frame([], DOCS)).collect() == [] and page_lines(frame([], PAGES)).collect() == []


def test_hot_site_and_line(frame):
    rows = [(i, "common\n" + ("rare" if i % 50 == 0 else f"own {i}"), "hot" if i % 3 else f"s{i}", 0, "", "") for i in range(3000)]
    out = drop_lines(frame(rows, DOCS)).collect()
    left = defaultdict(set)
    for r in out:
        left[r.source].add(r.text)
    assert all("common" not in t for t in left["hot"]) and "rare" in left["hot"] and left["s0"] == {"common\nrare"}


def test_copies_are_no_boilerplate(frame):
    words = [f"word{i}" for i in range(40)]
    text = "\n".join(" ".join(words[i : i + 8]) for i in range(0, 40, 8))
    rows = [(i, text, "s", len(text), "", "") for i in range(3)]
    rows += [(10 + i, f"head\nthis is {i} " + " ".join(f"own{i}x{j}" for j in range(20)), "s", 0, "", "") for i in range(6)]
    moved = "\n\n".join(reversed(text.split("\n")))
    rows += [(30 + i, [text, moved][i % 2], "t", 0, "", "") for i in range(9)]
    out = keep_one(drop_lines(frame(rows, DOCS)), shingle=5, percent=80).collect()
    assert [r.text for r in out if r.doc_id < 10] == [text]
    assert sorted(r.text.split("\n")[0][:7] for r in out if 10 <= r.doc_id < 30) == ["this is"] * 6
    assert {r.text for r in out if r.doc_id >= 30} <= {text, moved} and any(r.doc_id >= 30 for r in out)


def test_sentences_of_a_large_source(frame):
    notice, short, rare = "Read more about this on our site", "See also", "This line stands in few of them"
    rows = []
    for i in range(400):
        lines = [f"text {i} has line {j} of its own" for j in range(3)]
        lines += [notice] * (i % 10 == 0) + [short] * (i % 10 == 1) + [rare] * (i % 40 == 2)
        rows.append((i, "\n".join(lines), "s", 0, "", ""))
    near = [f"line {j} of a text that has near copies" for j in range(9)]
    rows += [(1000 + i, "\n".join([*near, f"and here is number {i}"]), "s", 0, "", "") for i in range(40)]
    rows += [(2000, notice, "t", 0, "", "")]
    out = {r.doc_id: r.text for r in drop_lines(frame(rows, DOCS)).collect()}
    assert out == {r[0]: r[1].replace(f"\n{notice}", "") for r in rows}


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert compare(QUERIES["op2_line_dedup"](spark, sf_dir), connect(sf_dir), ORACLES["op2_line_dedup"]) == ""
