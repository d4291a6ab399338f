"""Archives against a sequential reading of their bytes."""

import base64
import glob
import gzip
import hashlib
import random

import pytest

from studylake.llm import warc
from studylake.llm.queries import QUERIES
from studylake.llm.warc import archive_pages, boundaries, candidates, entries, page_records, pieces, read_warc, verify_warc, write_warc

SCHEMA = "page_id long, url string, html string, payload string, key long"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nPage-Id: 999\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def digest(payload):
    return base64.b32encode(hashlib.sha1((payload or "").encode()).digest()).decode()


def plainly(rows, min_bytes=0):
    """Sorted (page_id, bytes, digest, type, refers_to) of rows (page_id, html)."""
    largest = {}
    for page_id, html in rows:
        known = largest.get(html or "")
        largest[html or ""] = page_id if known is None or (page_id is not None and page_id > known) else known
    out = []
    for page_id, html in rows:
        size = len((html or "").encode())
        own = size < min_bytes or page_id == largest[html or ""]
        out.append((page_id, size, digest(html), "response" if own else "revisit", None if own else largest[html or ""]))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=repr)


def read_plainly(raw: bytes):
    """(offset, fields, block) of each record, one after the other."""
    at, out = 0, []
    while at < len(raw):
        assert raw.startswith(b"WARC/1.1\r\n", at)
        end = raw.index(b"\r\n\r\n", at)
        fields = dict(line.split(b": ", 1) for line in raw[at:end].split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        out.append((at, fields, raw[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
        assert raw[at - 4 : at] == b"\r\n\r\n"
    return out


def odd_pages(n, rng):
    pool = [
        None, "", "x", "WARC/1.1\r\n", "WARC/1.1", "\r\n\r\nWARC/1.1\r\n\r\n", FAKE, FAKE * 20, f"before{FAKE}after\r\n", "a\r\n", "\r\n", "\r\n\r\n\r\n",
        "WARC/1.WARC/1.1\r\nContent-Length: 3\r\n\r\n", "é日🙂" * 40, "WARC/1.1\r\nContent-Length: 99999999999999999999\r\n\r\n", "<html>" + "z" * 100_000,
        "WARC/1.1\r\nContent-Length: -4\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n", "﻿bom", "W" * 30,
    ]
    urls = [None, "", "http://a.b/c d", "http://x/WARC/1.1", "http://x/\r\nWARC/1.1\r\nContent-Length: 2\r\n\r\nab", "https://é.org/?q=1"]
    rows = []
    for i in range(n):
        html = rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice(["WARC/1.1\r\n", "\r\n", "Content-Length: 7", "text ", FAKE]) for _ in range(rng.randint(1, 30)))
        rows.append((rng.choice([None, i, i, i, i, 7]), rng.choice(urls), html, "clash", 0))
    return rows


@pytest.mark.parametrize("compression", ["gzip", None])
def test_round_trip(spark, frame, compression):
    rows = odd_pages(250, random.Random(3))
    out = archive_pages(frame(rows, SCHEMA), compression=compression)
    assert found(out) == plainly([(r[0], r[2]) for r in rows])


def test_small_payloads_are_all_responses(spark, frame):
    rows = [(i, None, t, "", 0) for i, t in enumerate(["", "", "ab", "ab", "long text", "long text", None])]
    assert found(archive_pages(frame(rows, SCHEMA), min_bytes=5)) == plainly([(r[0], r[2]) for r in rows], 5)


def read_in_splits(spark, path, size):
    """The pieces of archives that Spark reads in splits of so many bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", str(size // 2 + 1))
        return pieces(spark, path)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


@pytest.mark.parametrize("size", [61, 997, 20011, 300_007])
def test_splits_anywhere(spark, frame, tmp_path, size):
    rows = [r for r in odd_pages(150, random.Random(size)) if size > 100 or len(r[2] or "") < 300]
    path = str(tmp_path / "archive")
    write_warc(frame(rows[: 1000 if size > 100 else 40], SCHEMA).coalesce(1), path, compression=None)
    cut = read_in_splits(spark, path, size)
    assert size > 50_000 or cut.select("file", "block").distinct().count() > 2
    files = {f.split("/")[-1]: open(f, "rb").read() for f in glob.glob(f"{path}/part-*")}
    got = sorted((r.file.split("/")[-1], r["at"]) for r in boundaries(cut, 5000).where("reached").collect())
    assert got == sorted((f, at) for f, raw in files.items() for at, _, _ in read_plainly(raw))


def test_records_over_many_stretches(spark, frame, tmp_path):
    path = str(tmp_path / "archive")
    write_warc(frame(odd_pages(150, random.Random(4)), SCHEMA).coalesce(1), path, compression=None)
    files = {f.split("/")[-1]: open(f, "rb").read() for f in glob.glob(f"{path}/part-*")}
    expected = sorted(block for raw in files.values() for _, _, block in read_plainly(raw))
    assert sorted(bytes(r.payload) for r in read_warc(spark, path, stretch=700).collect()) == expected
    checked = verify_warc(spark, path, stretch=500).collect()
    assert all(r.complete and r.n_bytes == len(files[r.file.split("/")[-1]]) for r in checked)
    assert sum(r.n_rejected for r in checked) == sum(raw.count(b"WARC/1.1\r\n") for raw in files.values()) - len(expected) > 100


def test_rounds_grow_with_the_logarithm_of_the_stretches(spark, frame, tmp_path):
    path = str(tmp_path / "archive")
    write_warc(frame([(i, None, f"{i}" * 50, "", 0) for i in range(400)], SCHEMA).coalesce(1), path)
    steps = candidates(pieces(spark, path), 1000)
    exits = steps.groupBy("file", "stretch").applyInArrow(warc._followed, f"{warc._STEP}, exit long")
    found_, rounds = entries(exits)
    stretches = steps.where("next IS NOT NULL").groupBy("file").agg({"stretch": "max"}).agg({"max(stretch)": "max"}).first()[0] + 1
    assert stretches > 16 and 2 ** (rounds - 1) <= stretches
    assert found_.count() >= stretches / 2


def archive(tmp_path, raw, zipped=False):
    folder = tmp_path / hashlib.md5(raw).hexdigest()
    folder.mkdir()
    if zipped:
        (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(part) for part in raw.split(b"|")))
    else:
        (folder / "a.warc").write_bytes(raw)
    return str(folder)


def record(fields, block):
    return b"WARC/1.1\r\n" + b"\r\n".join(fields) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """Another order and case of fields, a gzip member for each record, bytes that are no UTF-8."""
    one = record([b"content-length:4", b"warc-type: warcinfo"], b"a|b\xff".replace(b"|", b"-"))
    two = record([b"WARC-Type: resource", b"Content-Length: 18", b"WARC-Target-URI: <http://x>"], b"\x00WARC/1.1\r\n\xfe\xfe\r\n\r\n.")
    for path in (archive(tmp_path, one + two), archive(tmp_path, one + b"|" + two, True)):
        got = sorted((r.record_type, bytes(r.payload), r.target_uri) for r in read_warc(spark, path).collect())
        assert got == [("resource", b"\x00WARC/1.1\r\n\xfe\xfe\r\n\r\n.", "<http://x>"), ("warcinfo", b"a-b\xff", None)]


def test_broken_chains_are_told(spark, tmp_path):
    whole = [record([b"WARC-Type: resource", b"Content-Length: 3"], b"%03d" % i) for i in range(5)]
    wrong = record([b"WARC-Type: resource", b"Content-Length: 2"], b"xyz")
    path = archive(tmp_path, b"".join(whole) + wrong + b"".join(whole))
    row = verify_warc(spark, path).collect()[0]
    assert (row.n_candidates, row.n_records, row.n_rejected, row.complete) == (11, 6, 5, False)
    with pytest.raises(ValueError, match="a.warc"):
        read_warc(spark, path)
    assert sorted(bytes(r.payload) for r in read_warc(spark, path, strict=False).collect()) == [b"%03d" % i for i in range(5)] + [b"xy"]
    cut_off = archive(tmp_path, b"".join(whole)[:-9])
    assert not verify_warc(spark, cut_off).collect()[0].complete
    garbage = archive(tmp_path, b"no archive at all")
    assert read_warc(spark, garbage, strict=False).collect() == []


def test_no_rows(spark, frame):
    assert archive_pages(frame([], SCHEMA)).collect() == []


def test_revisits_without_their_response(spark, frame, tmp_path):
    path = archive(tmp_path, record([b"WARC-Type: revisit", b"WARC-Refers-To: <urn:uuid:0>", b"Page-Id: 4", b"Content-Length: 0"], b""))
    assert [tuple(r) for r in page_records(read_warc(spark, path)).collect()] == [("4", None, None, "revisit", None)]


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert found(QUERIES["op12_warc"](spark, sf_dir)) == plainly([(p.page_id, p.html) for p in pages])
