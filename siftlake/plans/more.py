"""Queries over further sources, store getters, enrichment, reports and extension points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import text
from siftlake.operators import alias, enrich, events, history, report, risk, sync, wordlist
from siftlake.plans import cells as cell_plans
from siftlake.plans import files as file_plans
from siftlake.plans import store as store_plans
from siftlake.plans.source import CELLS_SQL, DUMP_SQL, cells, dump, table
from siftlake.scratch import shared_path
from siftlake.sources import dumps, large, parsers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Sources.
@query("a05_a12_json_objects", "SELECT 'false' AS a, n_name AS b, CAST(n_nationkey AS VARCHAR) AS c FROM nation")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation is a file of one object; all files are found by a glob."""
    one = F.concat(F.lit('{"b":{"z":'), "n_nationkey", F.lit(',"a":"'), "n_name", F.lit('"},"a":false}')).alias("value")
    path = shared_path(spark, "objects")
    table(spark, sf, "nation").select(one, F.col("n_nationkey").alias("key")).write.partitionBy("key").text(path)
    return dumps.load_dump(spark, f"{path}/key=*/*.txt", "json").selectExpr("cells[0] AS a", "cells[1] AS b", "cells[2] AS c")


@query("a06_json_scalars", "SELECT '' AS a, 'true' AS b, CAST(n_nationkey AS VARCHAR) AS c, '1.5' AS d, n_name AS e, '[1, t]' AS f, '{\"k\":1}' AS g FROM nation")
def a06(spark: SparkSession, sf: str) -> DataFrame:
    one = F.concat(F.lit("[null,true,"), "n_nationkey", F.lit(',1.5,"'), "n_name", F.lit('",[1,"t"],{"k":1}]'))
    doc = table(spark, sf, "nation").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value"))
    path = file_plans.write_text(doc, shared_path(spark, "scalars"))
    return dumps.load_dump(spark, path, "json").selectExpr(*[f"cells[{i}] AS {c}" for i, c in enumerate("abcdefg")])


@query("a10_json_array", "SELECT 'id:' || CAST(n_nationkey AS VARCHAR) AS a, 'note:\"}, {\"' AS b, 'type:\"' || n_name || '\"' AS c FROM nation")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    """An array of objects over two lines, with braces within strings; nothing behind an object is lost."""
    one = F.to_json(F.struct(F.col("n_name").alias("type"), F.col("n_nationkey").alias("id"), F.lit("}, {").alias("note")))
    doc = table(spark, sf, "nation").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ", "), F.lit("]\n")).alias("value"))
    path = file_plans.write_text(doc, shared_path(spark, "array"))
    return dumps.load_dump(spark, path, "jsonarray").selectExpr("cells[0] AS a", "cells[1] AS b", "cells[2] AS c")


_PATH = "'d.x/c' || CAST(c_custkey AS STRING) || CASE c_custkey % 8 WHEN 0 THEN '.CSV' WHEN 1 THEN '.tsv' WHEN 2 THEN '.Json' WHEN 3 THEN '.xml' WHEN 4 THEN '.jsonl' WHEN 5 THEN '.yaml' WHEN 6 THEN '.a.b' ELSE '' END"


@query("a13_format", "SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'csv' WHEN 1 THEN 'tsv' WHEN 2 THEN 'json' WHEN 3 THEN 'xml' WHEN 4 THEN 'jsonl' WHEN 7 THEN 'csv' END AS format FROM customer")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", dumps.dump_format(F.expr(_PATH)).alias("format"))


@query("a16_lossy_decode", "SELECT doc_id, sha256(text || chr(65533) || 'x' || chr(65533)) AS decoded FROM documents WHERE text IS NOT NULL")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a byte that is never UTF-8 and a character that is cut off at the end."""
    broken = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF78C3")))
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.sha2(F.make_valid_utf8(broken.cast("string")), 256).alias("decoded"))


@query("a01_large_csv", "SELECT l_orderkey AS a, 'line ' || CAST(l_linenumber AS STRING) || chr(10) || '\"x\", y' AS b, l_returnflag AS c FROM lineitem")
def a01_large(spark: SparkSession, sf: str) -> DataFrame:
    """CSV with line breaks in quotes, split over tasks by the reader for large files."""
    line = F.concat("l_orderkey", F.lit(',"line '), "l_linenumber", F.lit('\n""x"", y",'), "l_returnflag")
    path = file_plans.write_text(table(spark, sf, "lineitem").select(line.alias("value")), shared_path(spark, "large"))
    return large.read_rows(spark, path).selectExpr("CAST(cells[0] AS BIGINT) AS a", "cells[1] AS b", "cells[2] AS c")


@query("k01_adapter", "SELECT n_name AS a, CAST(n_nationkey AS VARCHAR) AS b FROM nation")
def k01(spark: SparkSession, sf: str) -> DataFrame:
    """A format that is added: cells between pipes."""
    parsers.register("pipes", lambda t: [line.split("|") for line in t.splitlines()])
    lines = table(spark, sf, "nation").select(F.concat_ws("|", "n_name", F.col("n_nationkey").cast("string")).alias("value"))
    path = file_plans.write_text(lines, shared_path(spark, "pipes"))
    return dumps.load_dump(spark, path, "pipes").selectExpr("cells[0] AS a", "cells[1] AS b")


# Scalars.
@query("b07_names", f"WITH cells AS ({CELLS_SQL}) SELECT row_id, col_name, lower(value) AS normalized FROM cells WHERE col_name IN ('full_name', 'address')")
def b07(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).where(F.col("col_name").isin("full_name", "address"))
    padded = F.concat(F.lit(" \t"), F.replace("value", F.lit(" "), F.lit("   ")))
    normalized = F.when(F.col("col_name") == "address", text.normalize_address(padded)).otherwise(text.normalize_name(padded))
    return c.select("row_id", "col_name", normalized.alias("normalized"))


@query("l07_email_aliases", f"WITH cells AS ({CELLS_SQL}) SELECT DISTINCT regexp_replace(split_part(lower(value), '@', 1), '\\+.*$', '') || '@' || split_part(lower(value), '@', 2) AS canonical, lower(value) AS variant, 'email_plus' AS alias_type, 95 AS confidence FROM cells WHERE contains(split_part(value, '@', 1), '+') AND contains(value, '@')")
def l07(spark: SparkSession, sf: str) -> DataFrame:
    return alias.find_email_aliases(cells(spark, sf))


_R01 = store_plans.SQL["r01_risk_score"]


@query("r05_weights", _R01.replace("CAST(0.3 AS FLOAT)", "CAST(0.5 AS FLOAT)").replace("CAST(0.15 AS FLOAT)", "CAST(0.75 AS FLOAT)"))
def r05(spark: SparkSession, sf: str) -> DataFrame:
    return store_plans.risks(spark, sf, risk.Weights(weak_password=0.5, pii=0.75))


# The store.
_BREACHES = "SELECT sha256('cust' || CAST(p_partkey % 400 AS STRING) || '@example.com') AS canonical_hash, p_brand AS breach_name FROM part"


def _breaches(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.sha2(F.concat(F.lit("cust"), (F.col("p_partkey") % 400).cast("string"), F.lit("@example.com")), 256).alias("canonical_hash"),
        F.col("p_brand").alias("breach_name"), F.col("p_size").cast("long").alias("pwn_count"),
    )


@query("g12_insert_breaches", f"SELECT DISTINCT canonical_hash, breach_name FROM ({_BREACHES})")
def g12(spark: SparkSession, sf: str) -> DataFrame:
    """Inserted twice: one row for each address and breach."""
    store = history.HistoryStore(spark, shared_path(spark, "store"))
    store.insert("address_breaches", _breaches(spark, sf))
    store.insert("address_breaches", _breaches(spark, sf))
    return store.read("address_breaches").select("canonical_hash", "breach_name")


@query("g13_getters", """SELECT 'alias' AS kind, md5(CAST(c_custkey AS STRING)) AS k, md5('v' || CAST(c_custkey AS STRING)) AS v, CAST(95 AS INT) AS n FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'anomaly', c_mktsegment, CAST(c_custkey AS STRING), CAST(c_custkey % 100 AS INT) FROM customer WHERE c_mktsegment = 'BUILDING'""")
def g13(spark: SparkSession, sf: str) -> DataFrame:
    """The aliases of the addresses, and the anomalies of the file, that a segment of customers names."""
    store = history.HistoryStore(spark, shared_path(spark, "store"))
    c = table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    store.insert("alias_relationships", c.select(F.md5(key).alias("canonical_hash"), F.md5(F.concat(F.lit("v"), key)).alias("variant_hash"), F.lit("email_plus").alias("alias_type"), F.lit(95).alias("confidence")))
    store.insert("anomaly_scores", c.select(F.col("c_mktsegment").alias("file_id"), key.alias("subject_hash"), F.lit("rare_domain").alias("anomaly_type"), (F.col("c_custkey") % 100).alias("risk_score")))
    asked = c.where("c_mktsegment = 'BUILDING'")
    links = store.aliases_of(asked.select(F.md5(key).alias("canonical_hash")))
    found = store.anomalies_of(asked.select(F.col("c_mktsegment").alias("file_id")))
    out = links.select(F.lit("alias").alias("kind"), F.col("canonical_hash").alias("k"), F.col("variant_hash").alias("v"), F.col("confidence").alias("n"))
    return out.union(found.select(F.lit("anomaly"), "file_id", "subject_hash", "risk_score"))


@query("g16_fields_json", "SELECT c_custkey, '[\"' || c_name || '\",\"file\"]' AS fields FROM customer")
def g16(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.array("c_name", F.lit("file_id:x"), F.lit("row_hash:y"), F.lit("source_file:z"), F.lit("file"))
    return table(spark, sf, "customer").select("c_custkey", history.plain_fields(fields).alias("fields"))


@query("g19_distinct_credentials", "SELECT md5(CAST(o_custkey % 37 AS STRING)) AS credential_hash, max(o_orderdate) AS created_at FROM orders WHERE o_custkey % 37 <> 5 GROUP BY 1")
def g19(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of one remainder have no credential."""
    group = F.col("o_custkey") % 37
    rows = table(spark, sf, "orders").select(F.when(group != 5, F.md5(group.cast("string"))).alias("credential_hash"), F.col("o_orderdate").alias("created_at"))
    return history.distinct_credentials(rows)


@query("j05_stale_peers", "WITH p AS (SELECT user_id AS peer_id, max(event_id) AS last_sync FROM events GROUP BY 1) SELECT peer_id, last_sync FROM p WHERE (SELECT max(event_id) FROM events) - last_sync > 300")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    peers = e.groupBy(F.col("user_id").alias("peer_id")).agg(F.max("event_id").alias("last_sync"))
    return sync.stale_peers(peers, e.agg(F.max("event_id")).first()[0])


@query("j02_replayed_batch", file_plans._COUNTS)
def j02(spark: SparkSession, sf: str) -> DataFrame:
    """The dump as two batches, the second of which comes twice, as after a failure between write and commit."""
    from siftlake.streaming import incremental

    store = history.HistoryStore(spark, shared_path(spark, "store"))
    run, rows = incremental.ingest_batch(store, "stream"), dump(spark, sf)
    half = rows.agg(F.percentile("row_idx", F.lit(0.5))).first()[0]
    run(rows.where(F.col("row_idx") <= half), 0)
    run(rows.where(F.col("row_idx") > half), 1)
    run(rows.where(F.col("row_idx") > half), 1)
    return store.read("normalized_rows").groupBy("event_type").agg(F.count("*").alias("n"))


# Enrichment.
_NEW_SQL = store_plans._HISTORY_SQL + ", na AS (SELECT address_hash FROM fa), emb AS (SELECT sha256('cust' || CAST(vec_id AS STRING) || '@example.com') AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) "


def _ingested(spark: SparkSession, sf: str, settings: enrich.Enrichment) -> dict[str, DataFrame]:
    """The earlier dump, then the dump, into a store with enrichment."""
    store = history.HistoryStore(spark, shared_path(spark, "store"))
    vectors = table(spark, sf, "embeddings").select(F.sha2(F.concat(F.lit("cust"), "vec_id", F.lit("@example.com")), 256).alias("address_hash"), "embedding")
    given = settings, vectors, _breaches(spark, sf)
    enrich.ingest_enriched(store, store_plans.earlier_rows(spark, sf), "earlier", *given)
    return enrich.ingest_enriched(store, dump(spark, sf), "dump", *given)


@query("f12_similar_to_new", _NEW_SQL + """, m AS (SELECT q.id AS query_id, s.id AS id, list_cosine_similarity(q.v, s.v) AS c FROM emb q JOIN emb s ON q.id IN (SELECT address_hash FROM na) AND s.id IN (SELECT address_hash FROM oa))
SELECT query_id, id, round(c, 6) AS similarity FROM m WHERE c >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) <= 5""")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    out = _ingested(spark, sf, enrich.Enrichment(embeddings=True, similarity=0.2))
    return out["similar"].withColumn("similarity", F.round("similarity", 6))


@query("f13_breaches_of_new", _NEW_SQL + f", b AS ({_BREACHES}) SELECT address_hash, count(DISTINCT breach_name) AS breach_count, count(breach_name) > 0 AS is_breached FROM na LEFT JOIN b ON canonical_hash = address_hash GROUP BY 1")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf, enrich.Enrichment(breaches=True))["breached"].select("address_hash", "breach_count", "is_breached")


@query("f14_provenance", store_plans.SQL["f00_event_counts"].replace("SELECT * FROM e", "SELECT *, 'dump' AS file_id FROM e"))
def f14(spark: SparkSession, sf: str) -> DataFrame:
    return store_plans.event_rows(spark, sf).groupBy("event_type", "file_id").agg(F.count("*").alias("n"))


@query("k03_plugins", "SELECT c_custkey, upper(c_name) AS name, length(c_name) AS size FROM customer")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    plugins = [lambda d: d.withColumn("size", F.length("c_name")), lambda d: d.withColumn("name", F.upper("c_name"))]
    return enrich.apply_plugins(table(spark, sf, "customer"), plugins).select("c_custkey", "name", "size")


@query("m04_custom_passwords", "SELECT md5(w) AS hash, w AS plaintext FROM (" + cell_plans._WEAK_SQL + " UNION ALL SELECT DISTINCT lower(c_mktsegment) FROM customer)")
def m04(spark: SparkSession, sf: str) -> DataFrame:
    custom = [r[0] for r in table(spark, sf, "customer").select(F.lower("c_mktsegment")).distinct().collect()]  # five segments
    return wordlist.digests(wordlist.rainbow_table(wordlist.builtin_words(spark, custom), with_ntlm=False), ("md5",)).select("hash", "plaintext")


# Reports.
_S01 = "(" + cell_plans.SQL["s01_ingest_summary"] + ")"
_NAMES = ["rows_processed", "unique_addresses", "hashed_credentials", "weak_passwords", "breached_addresses"]
_JSON_LINES = "['{', " + ", ".join(f"'  \"{n}\": ' || CAST({n} AS VARCHAR) || '{',' if n != _NAMES[-1] else ''}'" for n in _NAMES) + ", '}']"
_CSV_LINES = "['metric,value', " + ", ".join(f"'{n},' || CAST({n} AS VARCHAR)" for n in _NAMES) + "]"
_TEXT_LINES = "['Summary', " + ", ".join(f"'  {n}: ' || CAST({n} AS VARCHAR)" for n in _NAMES) + "]"
_JSONL_LINES = "['{\"event\": \"summary\", ' || " + " || ', ' || ".join(f"'\"{n}\": ' || CAST({n} AS VARCHAR)" for n in _NAMES) + " || '}', '{\"event\": \"metadata\"}']"


@query("s04_s07_formats", " UNION ALL ".join(
    f"SELECT '{k}' AS format, unnest(range(0, len({x}))) AS line_no, unnest({x}) AS line FROM {_S01}"
    for k, x in {"json": _JSON_LINES, "csv": _CSV_LINES, "text": _TEXT_LINES, "jsonl": _JSONL_LINES}.items()))
def s04(spark: SparkSession, sf: str) -> DataFrame:
    """The summary in all formats, line by line."""
    row = cell_plans.s01(spark, sf).first().asDict()
    summary = {n: row[n] for n in _NAMES}
    lines = [(k, i, x) for k, f in report.FORMATTERS.items() for i, x in enumerate("".join(f(summary)).splitlines())]
    return spark.createDataFrame(lines, "format string, line_no long, line string")


_SECTIONS = store_plans._HISTORY_SQL + f""", cells AS ({CELLS_SQL}), words AS ({cell_plans._WEAK_SQL}),
l AS (SELECT row_id, labels FROM ({cell_plans.LABELLED_SQL} SELECT * FROM l)),
al AS ({store_plans.SQL["l02_email_dot"]}), rk AS ({_R01})
SELECT 'duplicate_rows' AS section, count(*) AS n FROM ({store_plans._EVENTS["f11_duplicate_row"][1]})
UNION ALL SELECT 'new_addresses', count(*) FROM fa
UNION ALL SELECT 'compromised_with_new_credentials', count(*) FROM ({store_plans._EVENTS["f10_known_address_new_credential"][1]})
UNION ALL SELECT 'weak_passwords', count(DISTINCT row_id) FROM cells WHERE value IN (SELECT w FROM words)
UNION ALL SELECT 'pii_by_row', count(DISTINCT row_id) FROM l WHERE len(labels) > 0
UNION ALL SELECT 'pii_by_type', count(DISTINCT x) FROM (SELECT unnest(labels) AS x FROM l)
UNION ALL SELECT 'aliases', count(*) FROM (SELECT DISTINCT canonical, alias_type FROM al)
UNION ALL SELECT 'risk_by_row', count(*) FROM rk
UNION ALL SELECT 'risk_distribution', count(DISTINCT level) FROM rk"""


@query("s08_sections", _SECTIONS)
def s08(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows each section of the long report holds: events over the dump, findings over the cells."""
    found = report.findings(cells(spark, sf).select(F.lit("f").alias("file_id"), F.col("row_id").alias("row_idx"), F.lit(0).alias("col_idx"), "col_name", "value"))
    weak = wordlist.weak_plaintext_probe(found, "value", wordlist.builtin_words(spark))
    scored = store_plans.risk_rows(spark, sf).select(F.lit("f").alias("file_id"), F.col("c_custkey").alias("row_idx"), "r.*")
    sections = report.detailed_report(store_plans.event_rows(spark, sf), found, weak, store_plans.QUERIES["l02_email_dot"](spark, sf), scored)
    counts = [df.agg(F.lit(name).alias("section"), F.count("*").alias("n")) for name, df in sections.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


@query("g03_row_hash", DUMP_SQL + "SELECT row_idx, row_hash AS hash FROM good WHERE row_idx % 2 = 0")
def g03(spark: SparkSession, sf: str) -> DataFrame:
    """Row hashes of the dump are found by the probe; those of other rows are not."""
    ext = events.extract(dump(spark, sf)).where("NOT malformed")
    none = F.lit(None).cast("string")
    rows = ext.select(none.alias("address_hash"), none.alias("credential_hash"), "row_hash")
    odd = F.when(F.col("row_idx") % 2 == 0, F.col("row_hash")).otherwise(F.sha2("row_hash", 256))
    return history.contains_hash(ext.select("row_idx", odd.alias("hash")), rows).select("row_idx", "hash")
