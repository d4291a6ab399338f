"""One query for each text operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from studylake.llm.common import read_table
from studylake.llm.decontaminate import contamination
from studylake.llm.fill_middle import fill_in_middle
from studylake.llm.filter_audit import filter_audit
from studylake.llm.languages import identify
from studylake.llm.licenses import licenses
from studylake.llm.line_dedup import HTML_BREAK, page_lines
from studylake.llm.mixing import mix
from studylake.llm.near_dedup import near_duplicates
from studylake.llm.quality import quality
from studylake.llm.suffix_dedup import remove_repeats
from studylake.llm.topk import nearest
from studylake.llm.toxicity import toxicity
from studylake.llm.warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op5_minhash_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT rid, dw.n, s, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""


@query("op3_decontamination", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_OP2_SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') AS host,
    list_filter(list_transform(string_split_regex(coalesce(html, ''), '{HTML_BREAK}'), lambda x: trim(x)), lambda x: x <> '') AS lines FROM pages),
totals AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
often AS (
  SELECT host, line FROM (SELECT DISTINCT rid, host, unnest(lines) AS line FROM p) JOIN totals USING (host)
  GROUP BY host, line, pages HAVING count(*) >= 3 AND count(*) > pages * CAST(0.3 AS DOUBLE)),
x AS (SELECT rid, host, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM p),
kept AS (SELECT rid, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM x ANTI JOIN often USING (host, line) GROUP BY rid)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped,
  coalesce(text, '') AS text
FROM p LEFT JOIN kept USING (rid)"""


@query("op2_line_dedup", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_lines(read_table(spark, sf_dir, "pages"))


_OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 8) AS BIGINT) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
w AS (
  SELECT source, n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (
  SELECT *, row_number() OVER f AS k, sum(3 * n) OVER f - 3 * n AS cut, sum(weight) OVER () - sum(weight) OVER f + weight AS open,
    sum(n) OVER () AS total FROM w WINDOW f AS (ORDER BY 3 * n / CAST(weight AS DOUBLE), source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT min(CAST(total - cut AS DOUBLE) / CAST(open AS DOUBLE)) AS level FROM o
  WHERE weight * (CAST(total - cut AS DOUBLE) / CAST(open AS DOUBLE)) <= 3 * n
    AND k = (SELECT min(k) FROM o WHERE weight * (CAST(total - cut AS DOUBLE) / CAST(open AS DOUBLE)) <= 3 * n)),
t AS (SELECT source, n, least(weight * coalesce(level, 0), CAST(3 * n AS DOUBLE)) AS target FROM w, level),
c AS (
  SELECT source, n, target, CASE WHEN n > 0 THEN CAST(floor(target + 0.500001) AS BIGINT) // n ELSE 0 END AS base,
    CAST(floor(target + 0.500001) AS BIGINT) AS wanted FROM t)
SELECT doc_id, size, n AS source_size, target, CAST(base * size + greatest(0, least(size, wanted - base * n - coalesce(sum(size) OVER (
    PARTITION BY d.source ORDER BY draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source"""


@query("op6_mixing", _OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


_OP7_SQL = """
WITH w AS (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
v AS (SELECT rid, vec_id, list_resize(v, (SELECT max(len(v)) FROM w), CAST(0 AS DOUBLE)) AS v FROM w),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rid <> c.rid),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op7_knn_join", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


_OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * len(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(w.doc_id > least, false) THEN 16 ELSE 0 END AS mask
  FROM w JOIN firsts USING (t) LEFT JOIN marks ON w.doc_id = marks.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
prefixes AS (
  SELECT '' AS prefix, 0 AS step, 0 AS before, 0 AS bit, '' AS letter
  UNION ALL
  SELECT prefix || letters.letter, step + 1, before | prefixes.bit, letters.bit, letters.letter
  FROM prefixes, letters WHERE NOT contains(prefix, letters.letter)),
steps AS (
  SELECT part, prefix, step, letter,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM prefixes, cells WHERE step > 0 GROUP BY part, prefix, step, letter),
orders AS (SELECT prefix AS filter_order FROM prefixes WHERE step = 5),
full_steps AS (SELECT * FROM orders JOIN steps ON starts_with(filter_order, prefix)),
shares AS (SELECT part, letter, sum(removed) AS shapley FROM full_steps GROUP BY part, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM full_steps JOIN shares USING (part, letter)"""


@query("op11_filter_audit", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT h, payload, max(page_id) AS response FROM p GROUP BY h, payload)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT)
    >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM response THEN NULL ELSE response END AS refers_to
FROM p JOIN w USING (h, payload)"""


@query("op12_warc", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_pages(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (
  SELECT *, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
o AS (
  SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c),
r AS (
  SELECT doc_id, n, a, b, form, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN substr(split_part(output, '<S>', 1), 4) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1)
    ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || substr(split_part(output, '<P>', 1), 4) END) AS restored_sha256
FROM r"""


@query("op13_fill_in_middle", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
