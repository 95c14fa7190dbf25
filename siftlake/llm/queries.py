"""The thin queries of this subpackage: each applies one operator to its whole table. SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftlake.llm.common import read_table
from siftlake.scratch import spread

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.packing import pack

    return pack(spread(read_table(spark, sf_dir, "documents")), tokenizer_path("word_bpe_49k.json"), end_id=1, size=2048)


def op2_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.common import scratch
    from siftlake.llm.idstore import all_keys, read_store, write_store

    docs, path = read_table(spark, sf_dir, "documents"), scratch(spark, "id-store")
    write_store(docs, path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_store(spark, path, all_keys(docs))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from siftlake.llm.ann import search

    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.bpe import round_trip

    return round_trip(spread(read_table(spark, sf_dir, "documents")), tokenizer_path("byte_bpe_50k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.quality import judge

    return judge(spread(read_table(spark, sf_dir, "documents")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.common import scratch
    from siftlake.llm.warc import read_warc, write_warc

    path = scratch(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


#: The listed entries of op7: host, path, action.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.urlfilter import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.minhash import classes

    return classes(spread(read_table(spark, sf_dir, "documents")))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.substring import repeat_digest

    return repeat_digest(spread(read_table(spark, sf_dir, "documents")))


#: The JSON schema of op10's implied tool: a question of 4 to 40 words.
REPLY = {"reply": {
    "type": "object", "required": ["chars", "words"], "additionalProperties": False,
    "properties": {"chars": {"type": "integer", "minimum": 1}, "words": {"type": "integer", "minimum": 4, "maximum": 40}},
}}


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.llm.chat import conversation_items, link_calls

    return link_calls(conversation_items(read_table(spark, sf_dir, "conversations")), REPLY)


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_id_store": op2_id_store,
    "op3_ann": op3_ann,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_url_filter": op7_url_filter,
    "op8_minhash": op8_minhash,
    "op9_substring": op9_substring,
    "op10_chat": op10_chat,
}

_OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
), windows AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), rep AS (
  SELECT r, count(DISTINCT i + j) AS n FROM twice, range(0, 8) AS s(j) GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), f AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
), hosts AS (
  SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS k FROM b WHERE source <> '' GROUP BY source
), moments AS (
  SELECT sum(k) / sum(n) AS m, var_pop(k / n) AS v, avg(1 / n) AS few FROM hosts
), prior AS (
  SELECT m, CASE WHEN m * (1 - m) > 0 AND v > m * (1 - m) * few
    THEN least(greatest((m * (1 - m) - v) / (v - m * (1 - m) * few), 1.0), 1e4) ELSE 1e4 END AS c FROM moments
), bad AS (
  SELECT source FROM hosts, prior WHERE (k + m * c) / (n + c) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  bad.source IS NOT NULL AS host_failed, NOT base_failed AND bad.source IS NULL AS kept
FROM b LEFT JOIN bad ON b.source = bad.source
"""

_OP7 = """
WITH rules(rh, rp, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), p AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), hit AS (
  SELECT r, rh || rp AS rule, action,
    row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC, length(rh) DESC, action DESC) AS k
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM hit WHERE k = 1) USING (r)
"""

_OP10 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), i AS (
  SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS asked
  FROM c
), l AS (
  SELECT *, 'call-' || conv_id || '-' || asked AS call_id FROM i
), calls AS (
  SELECT conv_id, call_id, min(turn) AS call_turn FROM l WHERE kind = 'call' GROUP BY ALL
), answered AS (
  SELECT DISTINCT conv_id, call_id, true AS hit FROM l WHERE kind = 'result'
), j AS (
  SELECT l.*, call_turn, hit FROM l LEFT JOIN calls USING (conv_id, call_id) LEFT JOIN answered USING (conv_id, call_id)
), m AS (
  SELECT conv_id, turn, kind, call_id,
    CASE kind WHEN 'call' THEN hit IS NOT NULL WHEN 'result' THEN call_turn IS NOT NULL ELSE false END AS linked,
    CASE kind WHEN 'call' THEN length(text) >= 1 AND len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) BETWEEN 4 AND 40 ELSE true END AS valid,
    CASE kind WHEN 'result' THEN greatest(turn, coalesce(call_turn, turn)) ELSE turn END AS at_turn,
    CAST(kind = 'result' AND coalesce(call_turn >= turn, false) AS INT) AS level,
    '{' || CASE kind WHEN 'call' THEN '"arguments":{"chars":' || length(text) || ',"words":'
        || len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) || '},' ELSE '' END
      || CASE WHEN kind = 'message' THEN '' ELSE '"call_id":' || coalesce(to_json(call_id), 'null') || ',' END
      || '"content":' || to_json(text) || CASE kind WHEN 'call' THEN ',"name":"reply"' ELSE '' END
      || ',"role":' || to_json(role) || '}' AS message
  FROM j
)
SELECT conv_id, turn, kind, call_id, linked, valid, row_number() OVER (PARTITION BY conv_id
  ORDER BY at_turn NULLS FIRST, level, turn NULLS FIRST, call_id NULLS FIRST, message) - 1 AS position, message
FROM m
"""

_OP6 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), g AS (
  SELECT h, max(page_id) AS keep FROM p GROUP BY h
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = keep OR keep IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keep OR keep IS NULL THEN NULL ELSE keep END AS refers_to
FROM p JOIN g USING (h)
"""

_OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), c AS (
  SELECT doc_id, g, count(*) AS n FROM s GROUP BY ALL
), t AS (
  SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS shared
  FROM c AS a JOIN c AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM p JOIN t AS x ON x.doc_id = a JOIN t AS y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
)
SELECT d.doc_id, min(reach.b) AS class_id FROM d JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""

_OP9 = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT r, doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)
), least AS (
  SELECT g, min(doc_id) AS m FROM windows GROUP BY g
), gone AS (
  SELECT DISTINCT r, i + j AS p FROM windows JOIN least USING (g), range(0, 50) AS s(j) WHERE doc_id > m
), words AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op6_warc": _OP6, "op8_minhash": _OP8, "op9_substring": _OP9, "op5_quality": _OP5, "op7_url_filter": _OP7, "op10_chat": _OP10}
