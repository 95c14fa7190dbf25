"""Queries over dumps, the history store, anomalies, risk, aliases, similarity and event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import alias, anomaly, enrich, events, history, risk, similar, sync
from siftlake.plans.source import CELLS_SQL, DUMP_SQL, cells, dump, table
from siftlake.scratch import spread
from siftlake.sources import dumps
from siftlake.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# The event log. History: the events of an earlier dump, made from the customers.
_OLD_CELLS = [
    "'Cust' || CAST(c_custkey % 300 AS STRING) || '@Example.com'", "'user' || CAST(c_custkey % 700 AS STRING)",
    "'pw' || CAST(c_custkey % 23 AS STRING)",
]
_HISTORY_SQL = (
    DUMP_SQL + ", oldc AS (SELECT lower(" + _OLD_CELLS[0] + ") AS email, " + _OLD_CELLS[1] + " AS username, " + _OLD_CELLS[2] + " AS password FROM customer), "
    "old AS (SELECT sha256(email) AS address_hash, sha256(password) AS credential_hash, sha256(email || '|' || username || '|' || password) AS row_hash FROM oldc), "
    "oa AS (SELECT DISTINCT address_hash FROM old), oc AS (SELECT DISTINCT credential_hash FROM old), "
    "op AS (SELECT DISTINCT address_hash, credential_hash FROM old), orr AS (SELECT DISTINCT row_hash FROM old), "
    "fa AS (SELECT address_hash, min(row_idx) AS row_idx FROM good WHERE address_hash NOT IN (SELECT address_hash FROM oa) GROUP BY 1), "
    "fc AS (SELECT credential_hash, min(row_idx) AS row_idx FROM good WHERE credential_hash NOT IN (SELECT credential_hash FROM oc) GROUP BY 1), "
    "fp AS (SELECT address_hash, credential_hash, min(row_idx) AS row_idx FROM good ANTI JOIN op USING (address_hash, credential_hash) GROUP BY ALL), "
    "fr AS (SELECT row_hash, min(row_idx) AS row_idx FROM good WHERE row_hash NOT IN (SELECT row_hash FROM orr) GROUP BY 1) "
)
_EVENTS = {
    "f03_malformed_row": ("malformed_row", "SELECT row_idx, CAST(NULL AS VARCHAR) AS address_hash, CAST(NULL AS VARCHAR) AS credential_hash, CAST(NULL AS VARCHAR) AS row_hash FROM dump WHERE malformed"),
    "f07_new_address": ("new_address", "SELECT row_idx, address_hash, CAST(NULL AS VARCHAR) AS credential_hash, CAST(NULL AS VARCHAR) AS row_hash FROM fa"),
    "f08_credential_hash": ("credential_hash", "SELECT row_idx, CAST(NULL AS VARCHAR) AS address_hash, credential_hash, CAST(NULL AS VARCHAR) AS row_hash FROM fc"),
    "f09_addr_cred": ("addr_cred", "SELECT row_idx, address_hash, credential_hash, CAST(NULL AS VARCHAR) AS row_hash FROM fp"),
    "f10_known_address_new_credential": ("known_address_new_credential", "SELECT row_idx, address_hash, credential_hash, CAST(NULL AS VARCHAR) AS row_hash FROM fp WHERE NOT EXISTS (SELECT 1 FROM fa WHERE fa.address_hash = fp.address_hash AND fa.row_idx = fp.row_idx)"),
    "f11_duplicate_row": ("duplicate_row", "SELECT row_idx, CAST(NULL AS VARCHAR) AS address_hash, CAST(NULL AS VARCHAR) AS credential_hash, row_hash FROM good WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.row_hash = good.row_hash AND fr.row_idx = good.row_idx)"),
    "f11_row": ("row", "SELECT row_idx, CAST(NULL AS VARCHAR) AS address_hash, CAST(NULL AS VARCHAR) AS credential_hash, row_hash FROM fr"),
}


def earlier_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "CAST(0 AS BIGINT) AS file_seq", "'earlier' AS file_id", "c_custkey AS row_idx", "array(" + ", ".join(_OLD_CELLS) + ") AS cells",
        "array('email', 'username', 'password') AS header",
    )


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    return events.event_log(dump(spark, sf), events.history_of(events.event_log(earlier_rows(spark, sf))))


def _event(kind: str):
    return lambda spark, sf: event_rows(spark, sf).where(F.col("event_type") == kind).select("row_idx", "address_hash", "credential_hash", "row_hash")


for _name, (_kind, _sql) in _EVENTS.items():
    QUERIES[_name] = _event(_kind)
    SQL[_name] = _HISTORY_SQL + _sql


@query("f00_event_counts", _HISTORY_SQL + ", e AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS event_type, count(*) AS n FROM ({q})" for k, q in [*_EVENTS.values(), ("address_hash", _EVENTS["f07_new_address"][1])]) + ") SELECT * FROM e WHERE n > 0")
def f00(spark: SparkSession, sf: str) -> DataFrame:
    return event_rows(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))


@query("f01_file_hash", "SELECT 'file_hash' AS event_type, sha256(text) AS file_id, 'md5:' || md5(text) || ',sha256:' || sha256(text) AS fields FROM documents")
def f01(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a file."""
    files = spread(table(spark, sf, "documents")).select(F.sha2("text", 256).alias("file_id"), F.md5("text").alias("md5"))
    return events.file_events(files).withColumn("fields", F.array_join("fields", ","))


@query("f04_f05_extraction", DUMP_SQL + "SELECT row_idx, address_hash, credential_hash FROM good")
def f04(spark: SparkSession, sf: str) -> DataFrame:
    ext = events.extract(dump(spark, sf)).where("NOT malformed")
    return ext.select("row_idx", F.element_at("addresses", 1)["hash"].alias("address_hash"), F.element_at("credentials", 1)["hash"].alias("credential_hash"))


@query("f06_hashed_only", "SELECT o_orderkey AS row_idx, 'cred_count:1' AS fields FROM orders WHERE o_orderkey % 4 = 1")
def f06(spark: SparkSession, sf: str) -> DataFrame:
    """A dump of one column without header cells for addresses; a quarter of its rows are hashes."""
    cell = F.when(F.col("o_orderkey") % 4 == 1, F.md5(F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("pw"), "o_orderkey"))
    rows = table(spark, sf, "orders").select(
        F.lit(0).cast("long").alias("file_seq"), F.lit("d").alias("file_id"), F.col("o_orderkey").alias("row_idx"),
        F.array(cell).alias("cells"), F.array(F.lit("credential")).alias("header"),
    )
    out = events.event_log(rows).where("event_type = 'hashed_credentials_only'")
    return out.select("row_idx", F.array_join("fields", ",").alias("fields"))


# Store operators.
_PAIRS_SQL = DUMP_SQL + ", pairs AS (SELECT address_hash, credential_hash, count(*) AS n FROM good GROUP BY ALL) "


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    ext = events.extract(dump(spark, sf)).where("NOT malformed")
    flat = ext.select("row_idx", F.element_at("addresses", 1)["hash"].alias("address_hash"), F.element_at("credentials", 1)["hash"].alias("credential_hash"))
    return flat.groupBy("address_hash", "credential_hash").agg(F.count("*").alias("n"))


def probe(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.sha2(F.concat(F.lit("cust"), "c_custkey", F.lit("@example.com")), 256).alias("address_hash"),
                    F.sha2(F.concat(F.lit("pw"), (F.col("c_custkey") % 40).cast("string")), 256).alias("credential_hash"))


_PROBE_SQL = ", probe AS (SELECT c_custkey, sha256('cust' || CAST(c_custkey AS STRING) || '@example.com') AS address_hash, sha256('pw' || CAST(c_custkey % 40 AS STRING)) AS credential_hash FROM customer) "


@query("g01_address_exists", _PAIRS_SQL + _PROBE_SQL + "SELECT c_custkey FROM probe SEMI JOIN pairs USING (address_hash)")
def g01(spark: SparkSession, sf: str) -> DataFrame:
    return history.address_exists(probe(spark, sf), pairs(spark, sf)).select("c_custkey")


@query("g02_address_has_credential", _PAIRS_SQL + _PROBE_SQL + "SELECT c_custkey FROM probe SEMI JOIN pairs USING (address_hash, credential_hash)")
def g02(spark: SparkSession, sf: str) -> DataFrame:
    return history.address_has_credential(probe(spark, sf), pairs(spark, sf)).select("c_custkey")


@query("g03_contains_hash", _PAIRS_SQL + _PROBE_SQL + ", h AS (SELECT address_hash AS hash FROM pairs UNION SELECT credential_hash FROM pairs), p AS (SELECT c_custkey, address_hash AS hash FROM probe UNION ALL SELECT c_custkey, credential_hash FROM probe) SELECT c_custkey, hash FROM p SEMI JOIN h USING (hash)")
def g03(spark: SparkSession, sf: str) -> DataFrame:
    p = probe(spark, sf).select("c_custkey", F.explode(F.array("address_hash", "credential_hash")).alias("hash"))
    return history.contains_hash(p, pairs(spark, sf).withColumn("row_hash", F.lit(None).cast("string"))).select("c_custkey", "hash")


@query("g04_insert_ignore", _PAIRS_SQL + ", new AS (SELECT sha256('cust' || CAST(c_custkey % 800 AS STRING) || '@example.com') AS address_hash, min(c_acctbal) AS least FROM customer GROUP BY 1) SELECT address_hash, least FROM new ANTI JOIN pairs USING (address_hash)")
def g04(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "customer").select(F.sha2(F.concat(F.lit("cust"), (F.col("c_custkey") % 800).cast("string"), F.lit("@example.com")), 256).alias("address_hash"), F.col("c_acctbal").alias("least"))
    return history.insert_ignore(pairs(spark, sf), new, ["address_hash"])


@query("g05_canonical_of", f"WITH cells AS ({CELLS_SQL}), a AS (SELECT sha256(lower(trim(value))) AS alternate_hash, sha256('u' || lpad(CAST(row_id AS STRING), 4, '0') || '@gmail.com') AS canonical_hash FROM cells WHERE col_name = 'alt_email') SELECT DISTINCT alternate_hash, canonical_hash FROM a")
def g05(spark: SparkSession, sf: str) -> DataFrame:
    from siftlake.functions import text

    a = cells(spark, sf).where("col_name = 'alt_email'").select(
        F.sha2(text.normalize_field(F.col("value")), 256).alias("alternate_hash"), F.sha2(text.normalize_email(F.col("value")), 256).alias("canonical_hash")
    ).distinct()
    return history.canonical_of(a, a.select("alternate_hash")).select("alternate_hash", "canonical_hash")


@query("g06_credentials_of", _PAIRS_SQL + "SELECT address_hash, count(*) AS credentials, CAST(sum(n) AS BIGINT) AS occurrences FROM pairs GROUP BY 1")
def g06(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).groupBy("address_hash").agg(F.count("*").alias("credentials"), F.sum("n").alias("occurrences"))


_EDGES_SQL = "WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), e AS (SELECT a.l_suppkey AS canonical_hash_1, b.l_suppkey AS canonical_hash_2, count(*) AS cooccurrence_count FROM s a JOIN s b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY ALL) "


@query("g07_cooccurrence", _EDGES_SQL + "SELECT * FROM e")
def g07(spark: SparkSession, sf: str) -> DataFrame:
    return history.cooccurrence(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), ["l_orderkey"], "l_suppkey")


@query("g08_neighbors", _EDGES_SQL + "SELECT canonical_hash_1 AS node, canonical_hash_2 AS neighbor, cooccurrence_count FROM e UNION ALL SELECT canonical_hash_2, canonical_hash_1, cooccurrence_count FROM e")
def g08(spark: SparkSession, sf: str) -> DataFrame:
    return history.neighbors(g07(spark, sf))


_COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))"


@query("g09_find_similar", f"WITH m AS (SELECT q.vec_id AS query_id, s.vec_id AS id, {_COS} AS c FROM embeddings q JOIN embeddings s ON q.vec_id % 20 = 0 AND q.vec_id <> s.vec_id) SELECT query_id, id, round(c, 6) AS similarity FROM m WHERE c >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) <= 5")
def g09(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return similar.find_similar(e, e.where("id % 20 = 0"), 0.3, 5).withColumn("similarity", F.round("similarity", 6))


@query("g10_cosine", f"SELECT q.vec_id AS a, s.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings q JOIN embeddings s ON s.vec_id = q.vec_id + 1")
def g10(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    pairs_ = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "a")
    return pairs_.select("a", "b", F.round(similar.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("g11_find_duplicates", f"WITH m AS (SELECT q.vec_id AS id, s.vec_id AS o, {_COS} AS c FROM embeddings q JOIN embeddings s ON q.vec_id % 20 = 0 AND s.vec_id % 20 <> 0), b AS (SELECT id, o, c FROM m WHERE c >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, o) = 1), x AS (SELECT q.vec_id AS id, min(s.vec_id) AS o FROM embeddings q JOIN embeddings s ON q.vec_id % 20 = 0 AND s.vec_id % 20 <> 0 AND q.vec_id // 40 = s.vec_id // 20 GROUP BY 1) SELECT id, o AS duplicate_of, 'hash' AS how FROM x UNION ALL SELECT id, o, 'similar' FROM b WHERE id NOT IN (SELECT id FROM x)")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    p = e.where("id % 20 = 0").withColumn("address_hash", F.floor(F.col("id") / 40).cast("string"))
    k = e.where("id % 20 <> 0").withColumn("address_hash", F.floor(F.col("id") / 20).cast("string"))
    return similar.find_duplicates(p, k, 0.3)


# Against all rows but their own, two thirds of the queries without a hash.
_GROUP = "CASE WHEN vec_id % 3 = 0 THEN vec_id // 120 END"


@query("g11_find_duplicates_all", f"WITH h AS (SELECT *, {_GROUP} AS h FROM embeddings), m AS (SELECT q.vec_id AS id, s.vec_id AS o, {_COS} AS c FROM embeddings q JOIN embeddings s ON q.vec_id % 20 = 0 AND q.vec_id <> s.vec_id), b AS (SELECT id, o, c FROM m WHERE c >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, o) = 1), x AS (SELECT q.vec_id AS id, min(s.vec_id) AS o FROM h q JOIN h s ON q.vec_id % 20 = 0 AND q.vec_id <> s.vec_id AND q.h = s.h GROUP BY 1) SELECT id, o AS duplicate_of, 'hash' AS how FROM x UNION ALL SELECT id, o, 'similar' FROM b WHERE id NOT IN (SELECT id FROM x)")
def g11_all(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    e = e.withColumn("address_hash", F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 120).cast("string")))
    return similar.find_duplicates(e.where("id % 20 = 0"), e, 0.3)


@query("g13_high_risk", "SELECT o_orderkey AS file_id, o_custkey AS risk_score FROM orders WHERE o_custkey > 900")
def g13(spark: SparkSession, sf: str) -> DataFrame:
    return history.high_risk(table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("risk_score")), 900)


@query("g14_db_stats", _PAIRS_SQL + """, b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 1),
t AS (SELECT address_hash, count(*) AS n FROM pairs GROUP BY 1 ORDER BY n DESC, address_hash LIMIT 1), c AS (SELECT count(*) AS n FROM customer), p AS (SELECT count(*) AS n, count(DISTINCT credential_hash) AS d FROM pairs)
SELECT c.n AS total_addresses, (SELECT count(*) FROM supplier) AS total_variants, p.d AS total_credentials, p.n AS total_address_credentials,
(SELECT count(*) FROM nation) AS total_cooccurrences, (SELECT count(*) FROM part) AS total_breaches, (SELECT count(*) FROM orders) AS total_rows,
(SELECT count(DISTINCT o_orderpriority) FROM orders) AS unique_datasets, b.p_brand AS top_breach, b.n AS top_breach_count, t.address_hash AS top_address, t.n AS top_address_count,
round(p.n / c.n, 9) AS avg_credentials_per_address, round((SELECT count(*) FROM supplier) / c.n, 9) AS avg_variants_per_address FROM b, t, c, p""")
def g14(spark: SparkSession, sf: str) -> DataFrame:
    tables = {
        "canonical_addresses": table(spark, sf, "customer"), "address_alternates": table(spark, sf, "supplier"),
        "address_credentials": pairs(spark, sf).withColumnRenamed("address_hash", "canonical_hash"), "address_cooccurrence": table(spark, sf, "nation"),
        "address_breaches": table(spark, sf, "part").withColumnRenamed("p_brand", "breach_name"),
        "normalized_rows": table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "dataset"),
    }
    rounded = {c: F.round(c, 9) for c in ("avg_credentials_per_address", "avg_variants_per_address")}
    return history.db_stats(tables).withColumns(rounded)


# Anomalies, risk, aliases.
_ENTROPY = "list_sum(list_transform(list_sort(list_distinct(string_split(v, ''))), lambda c: -((length(v) - length(replace(v, c, ''))) / strlen(v)) * log2((length(v) - length(replace(v, c, ''))) / strlen(v))))"
_VALUES = f"WITH cells AS ({CELLS_SQL}), x AS (SELECT row_id, col_name, value AS v FROM cells) "
_ENTROPY = f"CASE WHEN v = '' THEN 0 ELSE {_ENTROPY} END"


@query("e01_entropy", _VALUES + f"SELECT row_id, col_name, round({_ENTROPY}, 6) AS entropy FROM x")
def e01(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).select("row_id", "col_name", F.round(anomaly.entropy(F.col("value")), 6).alias("entropy"))


@query("e02_baseline", _VALUES + f", e AS (SELECT {_ENTROPY} AS e, strlen(v) AS n FROM x) SELECT round(avg(e), 6) AS mean_entropy, round(stddev_pop(e), 6) AS sd_entropy, round(avg(n), 6) AS mean_length, round(stddev_pop(n), 6) AS sd_length, count(*) AS n FROM e")
def e02(spark: SparkSession, sf: str) -> DataFrame:
    b = anomaly.baseline(cells(spark, sf))
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns if c != "n"], "n")


@query("e02_top_domains", "SELECT 'd' || CAST(l_suppkey % 13 AS STRING) || '.org' AS domain, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, domain LIMIT 10")
def e02b(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "lineitem").select(F.concat(F.lit("a@D"), (F.col("l_suppkey") % 13).cast("string"), F.lit(".org")).alias("value"))
    return anomaly.top_domains(v)


_OUT = ", e AS (SELECT *, {e} AS e, strlen(v) AS n FROM x), b AS (SELECT avg(e) AS me, stddev_pop(e) AS se, avg(n) AS ml, stddev_pop(n) AS sl FROM e) "


@query("e03_e04_outliers", f"WITH x AS (SELECT doc_id, text AS v FROM documents WHERE text <> '')" + _OUT.format(e=_ENTROPY) +
       "SELECT doc_id, CASE WHEN abs(e - me) / greatest(se, 0.1) > 3 THEN CASE WHEN e > me + 3 * se THEN 85 ELSE 75 END END AS entropy_risk, CASE WHEN sl >= 0.1 AND abs(n - ml) / sl > 3 THEN CASE WHEN n > ml THEN 70 ELSE 60 END END AS length_risk FROM e, b")
def e03(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents")).where("text <> ''").select("doc_id", F.col("text").alias("value"))
    return anomaly.outliers(d, keep=["doc_id"]).select("doc_id", "entropy_risk", "length_risk")


@query("e05_rare_domains", "WITH d AS (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS domain FROM pages), c AS (SELECT domain, count(*) AS n FROM d GROUP BY 1), f AS (SELECT *, n / (SELECT count(*) FROM d) AS frequency FROM c) SELECT domain, n, round(frequency, 9) AS frequency, CAST(floor(100 * (1 - frequency)) AS INT) AS risk FROM f WHERE frequency < 0.01")
def e05(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "pages").select(F.concat(F.lit("x@"), F.regexp_extract("url", "://([^/?#]*)", 1)).alias("value"))
    return anomaly.rare_domains(v).withColumn("frequency", F.round("frequency", 9))


_VARIETY = "CAST(regexp_matches(value, '[A-Z]') AS INT) + CAST(regexp_matches(value, '[a-z]') AS INT) + CAST(regexp_matches(value, '[0-9]') AS INT) + CAST(regexp_matches(value, '[^\\p{L}\\p{N}]') AS INT)"


@query("e06_password", f"WITH cells AS ({CELLS_SQL}) SELECT row_id, col_name, CASE WHEN strlen(value) = 0 OR strlen(value) > 256 THEN 'unusual_format' ELSE 'uniform_distribution' END AS kind, CASE WHEN strlen(value) = 0 OR strlen(value) > 256 THEN 90 ELSE 60 END AS risk, CASE WHEN strlen(value) = 0 OR strlen(value) > 256 THEN CAST(strlen(value) AS DOUBLE) ELSE CAST({_VARIETY} AS DOUBLE) END AS metric FROM cells WHERE strlen(value) = 0 OR strlen(value) > 256 OR ({_VARIETY} <= 1 AND strlen(value) < 20)")
def e06(spark: SparkSession, sf: str) -> DataFrame:
    a = anomaly.password_anomaly(F.col("value"))
    return cells(spark, sf).select("row_id", "col_name", a.alias("a")).where("a IS NOT NULL").select("row_id", "col_name", "a.kind", "a.risk", "a.metric")


@query("e07_unseen_combination", "SELECT DISTINCT l_returnflag || '|' || l_linestatus || '|' || CAST(l_linenumber AS STRING) AS combination, 40 AS risk FROM lineitem WHERE NOT (l_linenumber < 3)")
def e07(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    fields = ["l_returnflag", "l_linestatus", "l_linenumber"]
    seen = anomaly.unseen_combinations(lines.where("l_linenumber < 3"), fields).select("combination")
    return anomaly.unseen_combinations(lines, fields, seen)


@query("r01_risk_score", """WITH o AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS wp, c_custkey % 3 = 0 AS wh, c_custkey % 7 AS br, c_custkey % 5 = 0 AS nc,
(CASE WHEN c_custkey % 4 = 0 THEN 10 ELSE 0 END) + (CASE WHEN c_custkey % 6 = 0 THEN 3 ELSE 0 END) + (CASE WHEN c_custkey % 9 = 0 THEN 5 ELSE 0 END) + 1 AS pii, c_custkey % 11 AS an FROM customer),
f AS (SELECT k, CASE WHEN wp THEN 30 ELSE 0 END AS weak_password, CASE WHEN wh THEN 20 ELSE 0 END AS weak_hash,
CAST(least(least(br, 4) * 10 + CASE WHEN nc AND br > 0 THEN 20 ELSE 0 END, 40) AS INT) AS breach, least(pii, 25) AS pii, CAST(least(an, 8) AS INT) AS anomaly FROM o),
s AS (SELECT *, CAST(floor((CAST(weak_password AS FLOAT) * CAST(0.3 AS FLOAT) + CAST(weak_hash AS FLOAT) * CAST(0.2 AS FLOAT) + CAST(breach AS FLOAT) * CAST(0.4 AS FLOAT) + CAST(pii AS FLOAT) * CAST(0.15 AS FLOAT) + CAST(anomaly AS FLOAT) * CAST(0.1 AS FLOAT)) / CAST(123 AS FLOAT) * CAST(100 AS FLOAT)) AS INT) AS score FROM f)
SELECT k AS c_custkey, score, CASE WHEN score <= 10 THEN 'green' WHEN score <= 25 THEN 'yellow' WHEN score <= 50 THEN 'orange' WHEN score <= 75 THEN 'red' ELSE 'critical' END AS level, weak_password, weak_hash, breach, pii, anomaly FROM s""")
def r01(spark: SparkSession, sf: str) -> DataFrame:
    return risks(spark, sf)


def risk_rows(spark: SparkSession, sf: str, weights: risk.Weights | None = None) -> DataFrame:
    k = F.col("c_custkey")
    types = F.filter(F.array(F.when(k % 4 == 0, "ssn"), F.when(k % 6 == 0, "phone_number"), F.when(k % 9 == 0, "national_id"), F.lit("email")), lambda x: x.isNotNull())
    r = risk.risk_score(k % 2 == 0, k % 3 == 0, k % 7, k % 5 == 0, types, k % 11, weights)
    return table(spark, sf, "customer").select("c_custkey", r.alias("r"))


def risks(spark: SparkSession, sf: str, weights: risk.Weights | None = None) -> DataFrame:
    return risk_rows(spark, sf, weights).select("c_custkey", "r.score", "r.level", "r.weak_password", "r.weak_hash", "r.breach", "r.pii", "r.anomaly")


@query("r03_distribution", f"SELECT level, count(*) AS n FROM ({SQL['r01_risk_score']}) GROUP BY 1")
def r03(spark: SparkSession, sf: str) -> DataFrame:
    return risk.risk_distribution(r01(spark, sf))


_SAID = [
    ("c_custkey % 2 = 0", "'Uses weak/common password'"), ("c_custkey % 3 = 0", "'Hash algorithm is weak (MD5/SHA1/SHA256)'"),
    ("c_custkey % 7 > 0", "'Found in ' || CAST(c_custkey % 7 AS STRING) || ' breach(es)'"),
    ("c_custkey % 7 > 0 AND c_custkey % 5 = 0", f"'{risk.PHRASES['new_credential']}'"),
    ("c_custkey % 4 = 0", "'Contains ' || CAST(CASE WHEN c_custkey % 8 = 0 THEN 2 ELSE 1 END AS STRING) || ' PII field(s)'"),
    ("c_custkey % 11 > 0", "CAST(c_custkey % 11 AS STRING) || ' anomalies detected'"),
]


@query("r04_explanation", "SELECT c_custkey, coalesce(nullif(concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {p} END" for c, p in _SAID) + "), ''), 'No significant risk factors detected') AS explanation FROM customer")
def r04(spark: SparkSession, sf: str) -> DataFrame:
    """All six factors, in every combination."""
    k = F.col("c_custkey")
    types = F.when(k % 8 == 0, F.array(F.lit("ssn"), F.lit("email"))).when(k % 4 == 0, F.array(F.lit("ssn"))).otherwise(F.array().cast("array<string>"))
    r = risk.risk_score(k % 2 == 0, k % 3 == 0, k % 7, k % 5 == 0, types, k % 11)
    return table(spark, sf, "customer").select("c_custkey", r["explanation"].alias("explanation"))


@query("l01_email_plus", f"WITH cells AS ({CELLS_SQL}) SELECT row_id, regexp_replace(split_part(lower(value), '@', 1), '\\+.*$', '') || '@' || split_part(lower(value), '@', 2) AS canonical, lower(value) AS variant, 'email_plus' AS alias_type, 95 AS confidence FROM cells WHERE contains(split_part(value, '@', 1), '+') AND contains(value, '@')")
def l01(spark: SparkSession, sf: str) -> DataFrame:
    a = alias.email_plus_alias(F.col("value"))
    return cells(spark, sf).select("row_id", a.alias("a")).where("a IS NOT NULL").select("row_id", "a.*")


_VARIANTS = {
    "email_dot": "'Jo' || CASE WHEN c_custkey % 2 = 0 THEN '.' ELSE '' END || 'ann' || CAST(c_custkey % 51 AS STRING) || '@x.org'",
    "phone_normalization": "'+1 ' || CASE WHEN c_custkey % 2 = 0 THEN '(555) ' ELSE '555-' END || CAST(c_custkey % 91 AS STRING)",
    "national_id_variant": "'AB' || CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE ' ' END || CAST(c_custkey % 81 AS STRING) || 'c'",
    "user_id_variant": "CASE WHEN c_custkey % 2 = 0 THEN 'ab-' ELSE 'AB_' END || CAST(c_custkey % 71 AS STRING)",
    "username_case": "CASE WHEN c_custkey % 2 = 0 THEN 'User' ELSE 'uSER' END || CAST(c_custkey % 61 AS STRING)",
}
_KEYS = {
    "email_dot": ("lower(v)", "replace(split_part(lower(v), '@', 1), '.', '') || '@' || split_part(lower(v), '@', 2)", 85),
    "phone_normalization": ("v", "regexp_replace(v, '[^0-9]', '', 'g')", 90),
    "national_id_variant": ("v", "upper(regexp_replace(v, '[^\\p{L}\\p{N}]', '', 'g'))", 92),
    "user_id_variant": ("v", "lower(regexp_replace(v, '[^0-9A-Fa-f]', '', 'g'))", 88),
    "username_case": ("v", "lower(v)", 98),
}


def _alias(kind: str):
    return lambda spark, sf: alias.alias_links(table(spark, sf, "customer").selectExpr(f"{_VARIANTS[kind]} AS value"), kind)


for _i, _kind in enumerate(_VARIANTS):
    _form, _key, _conf = _KEYS[_kind]
    QUERIES[f"l0{_i + 2}_{_kind}"] = _alias(_kind)
    SQL[f"l0{_i + 2}_{_kind}"] = (
        f"WITH x AS (SELECT {_VARIANTS[_kind]} AS v FROM customer), d AS (SELECT DISTINCT {_form} AS v, {_key} AS k FROM x), "
        f"m AS (SELECT k, min(v) AS canonical FROM d GROUP BY 1) SELECT canonical, v AS variant, '{_kind}' AS alias_type, {_conf} AS confidence FROM d JOIN m USING (k) WHERE v <> canonical"
    )


@query("l08_canonical_forms", f"WITH x AS (SELECT DISTINCT {_VARIANTS['email_dot']} AS v FROM customer) SELECT replace(split_part(lower(v), '@', 1), '.', '') || '@' || split_part(lower(v), '@', 2) AS canonical_key, count(*) AS n, min(v) AS smallest, max(v) AS largest FROM x GROUP BY 1")
def l08(spark: SparkSession, sf: str) -> DataFrame:
    return alias.canonical_forms(table(spark, sf, "customer").selectExpr(f"{_VARIANTS['email_dot']} AS value"))


@query("l09_email_domain", f"WITH cells AS ({CELLS_SQL}) SELECT row_id, split_part(lower(trim(value)), '@', 1) || '@gmail.com' AS canonical, lower(trim(value)) AS variant, 'email_domain' AS alias_type, 90 AS confidence FROM cells WHERE col_name = 'alt_email'")
def l09(spark: SparkSession, sf: str) -> DataFrame:
    a = alias.email_domain_alias(F.btrim("value"))
    return cells(spark, sf).where("col_name = 'alt_email'").select("row_id", a.alias("a")).select("row_id", "a.*")


# Enrichment and synchronisation.
_BREACH_SQL = ", br AS (SELECT sha256('cust' || CAST(p_partkey % 400 AS STRING) || '@example.com') AS address_hash, p_brand, p_size FROM part) "


@query("m11_breaches", "WITH probe AS (SELECT DISTINCT sha256('cust' || CAST(c_custkey AS STRING) || '@example.com') AS address_hash FROM customer)" + _BREACH_SQL +
       "SELECT address_hash, count(DISTINCT p_brand) AS breach_count, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS pwn_count, count(p_brand) > 0 AS is_breached FROM probe LEFT JOIN br USING (address_hash) GROUP BY 1")
def m11(spark: SparkSession, sf: str) -> DataFrame:
    br = table(spark, sf, "part").select(
        F.sha2(F.concat(F.lit("cust"), (F.col("p_partkey") % 400).cast("string"), F.lit("@example.com")), 256).alias("canonical_hash"),
        F.col("p_brand").alias("breach_name"), F.col("p_size").cast("long").alias("pwn_count"), F.lit(None).cast("date").alias("breach_date"),
    )
    return enrich.breach_summary(probe(spark, sf), br).drop("last_breach")


@query("m10_peer_delta", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT 2 * o_custkey FROM orders)")
def m10(spark: SparkSession, sf: str) -> DataFrame:
    """The other store holds keys twice as large."""
    remote = table(spark, sf, "orders").select((2 * F.col("o_custkey")).alias("c_custkey"))
    return sync.peer_delta(table(spark, sf, "customer").select("c_custkey"), remote, ["c_custkey"])


@query("j04_live_peers", "WITH p AS (SELECT user_id AS peer_id, max(event_id) AS last_seen FROM events GROUP BY 1) SELECT peer_id, last_seen FROM p WHERE (SELECT max(event_id) FROM events) - last_seen < 120 ORDER BY last_seen DESC, peer_id LIMIT 32")
def j04(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("peer_id"), F.col("event_id").alias("last_seen"))
    now = e.agg(F.max("last_seen")).first()[0]
    return sync.live_peers(e, now)


@query("h_percentiles", "SELECT quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95, quantile_disc(o_totalprice, 0.99) AS p99 FROM orders")
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.percentiles(table(spark, sf, "orders"), "o_totalprice", [0.5, 0.95, 0.99])


# Sources and event time.
@query("a14_header", "SELECT doc_id, regexp_matches(text, '\\p{L}') AS header FROM documents")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    cells_ = F.split(F.col("text"), ",")
    return spread(table(spark, sf, "documents")).select("doc_id", dumps.is_header(cells_).alias("header"))


#: Bytes put in front of texts, by remainder of doc_id: is_binary and confidence of the whole.
_ODD = {1: ("6100", True, 95), 2: ("7F454C46", True, 99), 3: ("4D5A", True, 98), 4: ("FFFE", False, 40), 5: ("FEEDFACE", True, 98)}


@query("a15_safety", "SELECT doc_id, " + ", ".join(
    f"CASE doc_id % 7 {' '.join(f'WHEN {k} THEN {pick(v)}' for k, v in _ODD.items())} WHEN 6 THEN {six} ELSE {plain} END AS {name}" for name, pick, six, plain in (
        ("is_safe", lambda v: str(not v[1]).lower(), "false", "strlen(coalesce(text, '')) > 0"), ("is_binary", lambda v: str(v[1]).lower(), "true", "false"),
        ("confidence", lambda v: v[2], 80, 0))) + " FROM documents")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as they are, and behind NUL, ELF, MZ and Mach-O heads, bad UTF-8, or among as many control characters."""
    body, rest = F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.col("doc_id") % 7
    content = F.when(rest == 6, F.concat(body, F.repeat(F.lit("\u0001"), 9 * F.octet_length(body) + 9).cast("binary"))).otherwise(body)
    for k, (head, _, _) in _ODD.items():
        content = F.when(rest == k, F.concat(F.unhex(F.lit(head)), body)).otherwise(content)
    s = dumps.file_safety(content)
    return spread(table(spark, sf, "documents")).select("doc_id", s["is_safe"].alias("is_safe"), s["is_binary"].alias("is_binary"), s["confidence"].alias("confidence"))


@query("a17_compression", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'zip' WHEN 1 THEN 'gzip' WHEN 2 THEN 'bzip2' WHEN 3 THEN '7z' ELSE 'none' END AS kind FROM customer")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    magic = "CASE c_custkey % 5 WHEN 0 THEN '504B0304AA' WHEN 1 THEN '1F8B08' WHEN 2 THEN '425A68' WHEN 3 THEN '377ABCAF271C' ELSE '68656C6C6F' END"
    c = dumps.compression(F.unhex(F.expr(magic)), F.lit("a/b.BIN"))
    return table(spark, sf, "customer").select("c_custkey", c["kind"].alias("kind"))


@query("j07_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def j07(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.tumbling(table(spark, sf, "events"), "1 hour").withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("j07_sliding", "WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) - i * INTERVAL '1 hour' AS start, event_id FROM events, range(0, 3) r(i)) SELECT start, count(*) AS n FROM w GROUP BY 1")
def j07b(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.sliding(table(spark, sf, "events"), "3 hours", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("j07_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS n FROM k GROUP BY user_id, k")
def j07c(spark: SparkSession, sf: str) -> DataFrame:
    s = incremental.sessions(table(spark, sf, "events"), "30 minutes")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
