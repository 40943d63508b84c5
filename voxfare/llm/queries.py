"""Registered queries of the corpus operators, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxfare.llm import (
    filter_audit,
    fingerprints,
    line_dedup,
    nearest,
    packing,
    periodic_runs,
    ring,
    segmentation,
    simhash,
    substrings,
    token_files,
    toxicity,
    url_rules,
)
from voxfare.llm.common import table
from voxfare.llm.encoding import Encoder

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


@query
def op2_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


ORACLES["op2_url_sweep"] = r"""
WITH rules(rule, host, path, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
  ('net/fr/', 'net', '/fr/', 'block')),
urls AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
fits AS (SELECT u.page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM urls u LEFT JOIN fits f USING (page_id)
"""


@query
def op3_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op4_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), Encoder(public_tokenizers.path(BYTE_BPE)), end_id=1)


@query
def op5_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokens_round_trip(table(spark, sf_dir, "documents"), Encoder(public_tokenizers.path(BYTE_BPE)), end_id=0)


@query
def op6_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.segment_documents(table(spark, sf_dir, "documents"), segmentation.Pieces(public_tokenizers.path(PIECES)))


@query
def op8_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_documents(table(spark, sf_dir, "documents"))


@query
def op10_repeated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(table(spark, sf_dir, "documents"))


@query
def op11_filter_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_diagrams"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS mask
  FROM d LEFT JOIN (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || f.x || g.x || h.x AS filter_order FROM letter a, letter b, letter f, letter g, letter h WHERE a.bit | b.bit | f.bit | g.bit | h.bit = 31),
s AS (SELECT filter_order, k AS step, (SELECT bit FROM letter WHERE x = substr(filter_order, k, 1)) AS bit,
    (SELECT coalesce(sum(bit), 0) FROM letter WHERE contains(substr(filter_order, 1, k - 1), x)) AS done FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & CAST(done + bit AS INTEGER) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & CAST(done AS INTEGER) = 0 AND mask & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & CAST(done AS INTEGER) > 0 AND mask & bit > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & CAST(done AS INTEGER) = 0 AND mask & bit > 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & CAST(done AS INTEGER) = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""


@query
def op12_line_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest_rows(table(spark, sf_dir, "documents"))


ORACLES["op12_line_hashes"] = r"""
WITH x AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, coalesce(f.first < k.doc_id, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


@query
def op13_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))
