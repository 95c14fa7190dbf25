"""Queries over cell values: detectors, normalisation, hashes, summaries."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import detect, hashing, text
from siftlake.operators import report, wordlist
from siftlake.plans.source import CELLS_SQL, TOKENS_SQL, TRIMMED_SQL, cells, table, tokens
from siftlake.scratch import spread

QUERIES: dict = {}
SQL: dict[str, str] = {}

_SSN = "(length(d) = 9 AND left(d, 3) NOT IN ('000', '666', '999'))"
_STRIPPED = "regexp_replace(v, '[\\s-]', '', 'g')"
_OCT = "strlen(v)"
_DIGITS_OF = {n: f"try_cast(left(d, {n}) AS BIGINT)" for n in (2, 4, 6)}
_LUHN = (
    "(list_sum(list_transform(range(0, length(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[length(d) - i] AS INT) "
    "ELSE (2 * CAST(d[length(d) - i] AS INT)) // 10 + (2 * CAST(d[length(d) - i] AS INT)) % 10 END)) % 10 = 0)"
)
_NETWORK = (
    f"((left(d, 1) = '4' AND length(d) IN (13, 16, 19)) OR (length(d) = 16 AND ({_DIGITS_OF[2]} BETWEEN 51 AND 55 OR "
    f"{_DIGITS_OF[4]} BETWEEN 2221 AND 2720)) OR (length(d) = 15 AND left(d, 2) IN ('34', '37')) OR (length(d) BETWEEN 16 AND 19 "
    f"AND (left(d, 4) = '6011' OR {_DIGITS_OF[6]} BETWEEN 622126 AND 622925 OR left(d, 2) = '65' OR {_DIGITS_OF[4]} BETWEEN "
    "3528 AND 3589)) OR (length(d) = 14 AND left(d, 2) IN ('36', '38', '39')))"
)
_IPV4 = (
    "(regexp_matches(v, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}') AND regexp_matches(split_part(v, '/', 1), "
    "'^[0-9]{1,3}(\\.[0-9]{1,3}){3}$') AND list_max(list_transform(string_split(split_part(v, '/', 1), '.'), lambda x: "
    "coalesce(try_cast(x AS INT), 999))) < 256 AND NOT regexp_matches(v, "
    "'^(0|10|127|169\\.254|172\\.(1[6-9]|2[0-9]|3[01])|192\\.168|255\\.255\\.255\\.255)(\\.|/|$)'))"
)
_IPV6 = (
    f"((regexp_matches(v, '{detect.IPV6_WHOLE}') OR (regexp_matches(v, '{detect.IPV6_SHORT}') AND "
    "len(list_filter(string_split(v, ':'), lambda g: g <> '')) <= 7) OR "
    f"regexp_matches(v, '{detect.IPV6_ZONE}') OR regexp_matches(v, '{detect.IPV6_MAPPED}')) "
    "AND lower(v) <> '::1' AND NOT regexp_matches(v, '(?i)^(fe80:|f[cd][0-9a-f:])'))"
)
_NAME = (
    f"({_OCT} BETWEEN 3 AND 50 AND NOT regexp_matches(v, '[0-9]') AND contains(v, ' ') AND len(string_split_regex(v, '\\s+')) >= 2 "
    "AND len(list_filter(string_split_regex(v, '\\s+'), lambda w: regexp_matches(w, '^\\p{Lu}'))) >= len(string_split_regex(v, '\\s+')) // 2)"
)
_NATIONAL = (
    f"(NOT {_SSN} AND (regexp_matches({_STRIPPED}, '^[A-Za-z]{{2}}[0-9]{{6}}[A-Za-z]') OR regexp_matches({_STRIPPED}, "
    f"'^[0-9]{{8}}[A-Za-z]$') OR regexp_matches({_STRIPPED}, '^[A-Za-z]{{6}}[0-9]{{2}}[A-Za-z][0-9]{{2}}[A-Za-z][0-9]{{3}}[A-Za-z]$') "
    "OR length(d) IN (18, 10, 13, 14, 15, 9, 12)))"
)
_CRYPTO = (
    f"(CASE WHEN {_OCT} BETWEEN 26 AND 62 AND starts_with(v, 'bc1') THEN regexp_matches(v, '^bc1[0-9ac-hj-np-z]*$') "
    f"WHEN {_OCT} BETWEEN 26 AND 62 AND left(v, 1) IN ('1', '3') THEN regexp_matches(v, '^[1-9A-HJ-NP-Za-km-z]*$') "
    f"WHEN {_OCT} = 42 AND starts_with(v, '0x') THEN regexp_matches(v, '^0x[0-9A-Fa-f]*$') "
    f"WHEN {_OCT} BETWEEN 25 AND 34 AND starts_with(v, 'r') THEN regexp_matches(v, '^[0-9A-Za-z]*$') ELSE false END)"
)
_WALLET = (
    f"(CASE WHEN {_OCT} > 10 AND starts_with(v, 'acct_') THEN regexp_matches(v, '^acct_[A-Za-z0-9_-]*$') "
    f"WHEN {_OCT} > 15 AND starts_with(v, 'sq0asa-') THEN regexp_matches(v, '^sq0asa-[A-Za-z0-9]*$') "
    "ELSE regexp_matches(v, '^[A-Z0-9]{12,16}$') OR regexp_matches(v, '^[A-Za-z0-9_]{16,64}$') END)"
)
_CLEAN = "upper(replace(regexp_replace(v, '[ -]', '', 'g'), 'ß', 'SS'))"
_NODASH = "upper(replace(replace(v, '-', ''), 'ß', 'SS'))"
_WORDS = "|".join(detect.ADDRESS_WORDS)

#: Query name to (detector, the same rule in SQL over ``v`` trimmed and ``d`` digits), in the order of labels.
RULES: dict[str, tuple] = {
    "d01_email": (detect.is_email, f"(contains(v, '@') AND {_OCT} > 5)"),
    "d02_phone_number": (detect.is_phone, "(length(d) BETWEEN 10 AND 15 AND (left(v, 1) = '+' OR contains(v, '-') OR contains(v, ' ') OR contains(v, '(') OR length(d) = 10))"),
    "d03_ipv4": (detect.is_ipv4, _IPV4),
    "d04_ipv6": (detect.is_ipv6, _IPV6),
    "d05_ssn": (detect.is_ssn, _SSN),
    "d06_credit_card": (detect.is_credit_card, f"(length(d) BETWEEN 13 AND 19 AND {_LUHN} AND {_NETWORK})"),
    "d07_iban": (detect.is_iban, f"(strlen({_CLEAN}) BETWEEN 15 AND 34 AND regexp_matches({_CLEAN}, '^[A-Z]{{2}}[\\p{{L}}\\p{{N}}]*$'))"),
    "d08_swift_code": (detect.is_swift, f"(strlen({_NODASH}) IN (8, 11) AND regexp_matches({_NODASH}, '^[A-Z]{{6}}'))"),
    "d09_routing_number": (detect.is_routing_number, "(length(d) = 9 AND d <> '000000000')"),
    "d10_bank_account": (detect.is_bank_account, "(length(d) BETWEEN 8 AND 17 AND replace(d, left(d, 1), '') <> '')"),
    "d11_national_id": (detect.is_national_id, _NATIONAL),
    "d12_name": (detect.is_name, _NAME),
    "d13_mailing_address": (detect.is_mailing_address, f"({_OCT} BETWEEN 10 AND 200 AND regexp_matches(v, '[0-9]') AND regexp_matches(lower(v), '{_WORDS}'))"),
    "d14_crypto_address": (detect.is_crypto_address, _CRYPTO),
    "d15_digital_wallet": (detect.is_digital_wallet, _WALLET),
    "d17_email_like": (detect.is_email_like, "regexp_matches(v, '^[^@ ]+@([^@. ]+\\.)+[a-zA-Z]{2,}$')"),
    "h08_credential_hash": (hashing.is_credential_hash, (
        "(regexp_matches(v, '(?i)^(\\$2[aby]\\$|\\$7\\$|\\$argon2(id|i|d)\\$|\\$pbkdf2-sha(256|512)\\$)') OR (regexp_matches(v, '^[0-9A-Fa-f]+$') "
        "AND length(v) IN (32, 40, 64, 128)) OR (regexp_matches(v, '^[A-Za-z0-9+/=]+$') AND length(v) % 4 = 0 AND length(v) >= 24))")),
}


def _rule(predicate):
    return lambda spark, sf: cells(spark, sf).where(predicate(text.trim(F.col("value")))).select("row_id", "col_name", "value")


for _name, (_predicate, _sql) in RULES.items():
    QUERIES[_name] = _rule(_predicate)
    SQL[_name] = TRIMMED_SQL + f"SELECT row_id, col_name, value FROM c WHERE {_sql}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_LABEL_SQL = {
    "email": "d01_email", "phone_number": "d02_phone_number", "ipv4": "d03_ipv4", "ip_address": None, "ipv6": "d04_ipv6",
    "ssn": "d05_ssn", "credit_card": "d06_credit_card", "iban": "d07_iban", "swift_code": "d08_swift_code",
    "routing_number": "d09_routing_number", "bank_account": "d10_bank_account", "national_id": "d11_national_id", "name": "d12_name",
    "mailing_address": "d13_mailing_address", "crypto_address": "d14_crypto_address", "digital_wallet": "d15_digital_wallet",
}


def _labels_sql(column: str | None) -> str:
    parts = []
    for label, rule in _LABEL_SQL.items():
        if rule:
            also = ", 'ip_address'" if label in ("ipv4", "ipv6") else ""
            parts.append(f"CASE WHEN {RULES[rule][1]} THEN ['{label}'{also}] ELSE CAST([] AS VARCHAR[]) END")
    if column:
        parts.append(f"CASE WHEN regexp_matches(lower({column}), 'name|person|user') AND NOT {_NAME} THEN ['unknown'] ELSE CAST([] AS VARCHAR[]) END")
    return "flatten([" + ", ".join(parts) + "])"


LABELLED_SQL = TRIMMED_SQL + f", l AS (SELECT row_id, col_name, value, {_labels_sql('col_name')} AS labels FROM c) "


@query("d22_detect", LABELLED_SQL + "SELECT row_id, col_name, array_to_string(labels, ',') AS labels FROM l")
def d22(spark: SparkSession, sf: str) -> DataFrame:
    labels = detect.detect_pii(F.col("value"), F.col("col_name"))
    return cells(spark, sf).select("row_id", "col_name", F.array_join(labels, ",").alias("labels"))


_TOKEN_SQL = (
    f"WITH c AS (SELECT doc_id, lang, value, value AS v, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM ({TOKENS_SQL})), "
    f"l AS (SELECT doc_id, lang, unnest({_labels_sql(None)}) AS pii_type FROM c) "
)


@query("token_pii_by_lang", _TOKEN_SQL + "SELECT lang, pii_type, count(*) AS n, count(DISTINCT doc_id) AS documents FROM l GROUP BY ALL")
def token_pii(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: findings over all tokens of all documents, by language and type. The gate of the detectors stands in a
    filter, where it is compiled with the scan."""
    found = tokens(spark, sf).where(detect.may_match(F.col("value"))).select("doc_id", "lang", F.explode(detect.detect_pii(F.col("value"))).alias("pii_type"))
    return found.groupBy("lang", "pii_type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query("d11_countries", TRIMMED_SQL + f"""SELECT row_id, col_name, array_to_string(list_filter([
  CASE WHEN regexp_matches({_STRIPPED}, '^[A-Za-z]{{2}}[0-9]{{6}}[A-Za-z]') THEN 'GB' END,
  CASE WHEN regexp_matches({_STRIPPED}, '^[0-9]{{8}}[A-Za-z]$') THEN 'ES' END,
  CASE WHEN regexp_matches({_STRIPPED}, '^[A-Za-z]{{6}}[0-9]{{2}}[A-Za-z][0-9]{{2}}[A-Za-z][0-9]{{3}}[A-Za-z]$') THEN 'IT' END,
  CASE WHEN length(d) = 18 THEN 'CN' END, CASE WHEN length(d) = 10 THEN 'DE' END, CASE WHEN length(d) BETWEEN 13 AND 15 THEN 'FR' END,
  CASE WHEN length(d) = 9 THEN 'NL' END, CASE WHEN length(d) = 12 THEN 'JP' END, CASE WHEN length(d) = 12 THEN 'IN' END],
  lambda x: x IS NOT NULL), ',') AS countries FROM c""")
def d11_countries(spark: SparkSession, sf: str) -> DataFrame:
    found = F.transform(detect.national_id_matches(text.trim(F.col("value"))), lambda m: m["country"])
    return cells(spark, sf).select("row_id", "col_name", F.array_join(found, ",").alias("countries"))


@query("d16_review", LABELLED_SQL + "SELECT row_id, col_name FROM l WHERE list_contains(labels, 'unknown')")
def d16(spark: SparkSession, sf: str) -> DataFrame:
    v = text.trim(F.col("value"))
    return cells(spark, sf).where(detect.needs_review(F.col("col_name")) & ~detect.is_name(v)).select("row_id", "col_name")


@query("d18_extract_emails", TRIMMED_SQL + f"SELECT row_id, col_name, v AS email FROM c WHERE {RULES['d17_email_like'][1]}")
def d18(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).select("row_id", "col_name", detect.extract_email(F.col("value")).alias("email")).where("email IS NOT NULL")


_WEAK_SQL = "SELECT unnest([" + ", ".join(f"'{w}'" for w in wordlist.WEAK_PASSWORDS) + "]) AS w"


@query("d19_weak_hash", f"""WITH words AS ({_WEAK_SQL}), h AS (SELECT md5(w) AS h, w FROM words UNION ALL SELECT sha256(w), w FROM words)
SELECT l_orderkey, l_linenumber, w AS plaintext FROM lineitem JOIN h ON md5(CAST(l_orderkey % 130 AS STRING)) = h""")
def d19(spark: SparkSession, sf: str) -> DataFrame:
    """D-19, D-21: upper-case hashes of small numbers, of which some (``111``, ``123``) are hashes of weak passwords."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.upper(F.md5((F.col("l_orderkey") % 130).cast("string"))).alias("value"))
    hashes = wordlist.digests(wordlist.rainbow_table(wordlist.builtin_words(spark), with_ntlm=False))
    return wordlist.weak_hash_probe(lines, "value", hashes).where("plaintext IS NOT NULL").drop("value")


@query("d20_weak_plaintext", f"WITH words AS ({_WEAK_SQL}), cells AS ({CELLS_SQL}) SELECT row_id, col_name, value FROM cells WHERE value IN (SELECT w FROM words)")
def d20(spark: SparkSession, sf: str) -> DataFrame:
    return wordlist.weak_plaintext_probe(cells(spark, sf), "value", wordlist.builtin_words(spark)).select("row_id", "col_name", "value")


@query("s02_pii_summary", LABELLED_SQL + ", f AS (SELECT unnest(labels) AS x FROM l) SELECT " + ", ".join(
    f"CAST(count(*) FILTER (x IN ({', '.join(repr(n) for n in names)})) AS BIGINT) AS {c}" for c, names in report.COUNTERS.items()) + " FROM f")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    found = cells(spark, sf).withColumn("labels", detect.detect_pii(F.col("value"), F.col("col_name")))
    return report.pii_summary(found)


@query("s03_detailed_findings", LABELLED_SQL + """SELECT row_id AS row_idx, CAST(sum(len(labels)) AS BIGINT) AS n_findings,
count(*) FILTER (regexp_matches(trim(value), '^[^@ ]+@([^@. ]+\\.)+[a-zA-Z]{2,}$')) AS n_emails, row_id AS row_number FROM l GROUP BY row_id HAVING sum(len(labels)) > 0""")
def s03(spark: SparkSession, sf: str) -> DataFrame:
    found = cells(spark, sf).select(F.lit("f").alias("file_id"), F.col("row_id").alias("row_idx"), F.hash("col_name").alias("col_idx"), "col_name", "value")
    rows = report.detailed_findings(report.detected_rows(report.findings(found)))
    return rows.select("row_idx", F.size("findings").cast("long").alias("n_findings"), F.size("emails").cast("long").alias("n_emails"), "row_number")


_MAIL = "regexp_matches(trim(value), '^[^@ ]+@([^@. ]+\\.)+[a-zA-Z]{2,}$')"


@query("s01_ingest_summary", f"""WITH cells AS ({CELLS_SQL}), words AS ({_WEAK_SQL}), h AS (SELECT md5(w) AS h FROM words UNION SELECT sha256(w) FROM words),
r AS (SELECT row_id, max({_MAIL}) AS m, max(lower(value) IN (SELECT h FROM h)) AS k FROM cells GROUP BY 1)
SELECT count(*) AS rows_processed, count(*) FILTER (m) AS unique_addresses, count(*) FILTER (k) AS hashed_credentials,
(SELECT count(DISTINCT trim(value)) FROM cells WHERE {_MAIL}) AS distinct_addresses, (SELECT count(DISTINCT row_id) FROM cells WHERE value IN (SELECT w FROM words)) AS weak_passwords, CAST(0 AS BIGINT) AS breached_addresses FROM r""")
def s01(spark: SparkSession, sf: str) -> DataFrame:
    found = cells(spark, sf).select(F.lit("f").alias("file_id"), F.col("row_id").alias("row_idx"), F.lit(0).alias("col_idx"), "col_name", "value")
    rows = table(spark, sf, "customer").select(F.lit("f").alias("file_id"), F.col("c_custkey").alias("row_idx"))
    words = wordlist.builtin_words(spark)
    hashes = wordlist.digests(wordlist.rainbow_table(words, with_ntlm=False))
    weak = wordlist.weak_hash_probe(found, "value", hashes).where("plaintext IS NOT NULL")
    plain = wordlist.weak_plaintext_probe(found, "value", words)
    return report.ingest_summary(rows, report.findings(found), weak, plain).drop("file_id")


@query("s08_pii_by_type", LABELLED_SQL + "SELECT pii_type, count(*) AS n FROM (SELECT unnest(labels) AS pii_type FROM l) GROUP BY 1")
def s08(spark: SparkSession, sf: str) -> DataFrame:
    found = report.findings(cells(spark, sf).select(F.lit("f").alias("file_id"), F.col("row_id").alias("row_idx"), F.lit(0).alias("col_idx"), "col_name", "value"))
    nothing = spark.createDataFrame([], "event_type string, file_id string, row_idx long, row_hash string, address_hash string, credential_hash string")
    return report.detailed_report(nothing, found, nothing)["pii_by_type"]


_FOLD = "trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@query("b01_normalize_field", f"SELECT doc_id, sha256({_FOLD}) AS normalized FROM documents")
def b01(spark: SparkSession, sf: str) -> DataFrame:
    x = text.normalize_field(F.coalesce("text", F.lit("")))
    return spread(table(spark, sf, "documents")).select("doc_id", F.sha2(x, 256).alias("normalized"))


@query("b02_normalize_row", "SELECT doc_id, array_to_string([" + _FOLD + ", lower(lang), lower(source)], '|') AS normalized FROM documents")
def b02(spark: SparkSession, sf: str) -> DataFrame:
    row = text.normalize_row(F.array("text", "lang", "source"))
    return spread(table(spark, sf, "documents")).select("doc_id", F.array_join(row, "|").alias("normalized"))


@query("b03_normalize_email", TRIMMED_SQL + """SELECT row_id, col_name, replace(regexp_replace(split_part(lower(v), '@', 1), '\\+.*$', ''), '.', '') || '@'
|| CASE split_part(lower(v), '@', 2) WHEN 'googlemail.com' THEN 'gmail.com' ELSE split_part(lower(v), '@', 2) END AS normalized FROM c WHERE contains(v, '@')""")
def b03(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).where(F.col("value").contains("@")).select("row_id", "col_name", text.normalize_email(F.col("value")).alias("normalized"))


@query("b04_domain_rules", "SELECT unnest(['bankofamerica.com', 'ml.com', 'googlemail.com', 'ymail.com', 'rocketmail.com', 'outlook.com', 'hotmail.com', 'live.com', 'aws.amazon.com']) AS alternate, "
       "unnest(['bofa.com', 'bofa.com', 'gmail.com', 'yahoo.com', 'yahoo.com', 'microsoft.com', 'microsoft.com', 'microsoft.com', 'amazon.com']) AS canonical")
def b04(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(F.explode(text.suffix_map()).alias("alternate", "canonical"))


_CASE_PREFIX = "CASE n_name " + " ".join(f"WHEN '{n}' THEN '{text.PHONE_PREFIXES[c]}'" for n, c in
    {"UNITED STATES": "US", "FRANCE": "FR", "GERMANY": "DE", "CHINA": "CN", "INDIA": "IN", "JAPAN": "JP", "BRAZIL": "BR"}.items()) + " END"
_CASE_CODE = "CASE n_name WHEN 'UNITED STATES' THEN 'us' WHEN 'FRANCE' THEN 'FR' WHEN 'GERMANY' THEN 'DE' WHEN 'CHINA' THEN 'CN' WHEN 'INDIA' THEN 'IN' WHEN 'JAPAN' THEN 'JP' WHEN 'BRAZIL' THEN 'BR' END"
_PHONE = "CASE WHEN c_custkey % 3 = 0 THEN '+' ELSE '' END || '(' || CAST(c_custkey * 7919 AS STRING) || ') 55-' || CAST(c_custkey AS STRING)"


@query("b05_phone_e164", f"""WITH p AS (SELECT c_custkey, {_PHONE} AS phone, {_CASE_PREFIX} AS prefix FROM customer JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM p)
SELECT c_custkey, CASE WHEN prefix IS NULL THEN NULL WHEN starts_with(d, prefix) OR left(phone, 1) = '+' THEN '+' || d ELSE '+' || prefix || d END AS e164 FROM d""")
def b05(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    p = c.selectExpr("c_custkey", f"{_PHONE} AS phone", f"{_CASE_CODE} AS country")
    return p.select("c_custkey", text.normalize_phone_e164(F.col("phone"), F.col("country")).alias("e164"))


@query("b06_normalize_ip", TRIMMED_SQL + "SELECT row_id, lower(v) AS ip FROM c WHERE col_name IN ('ipv4', 'ipv6')")
def b06(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).where(F.col("col_name").isin("ipv4", "ipv6")).select("row_id", text.normalize_ip(F.col("value")).alias("ip"))


@query("h01_digests", "SELECT doc_id, md5(coalesce(text, '')) AS md5, sha1(coalesce(text, '')) AS sha1, sha256(coalesce(text, '')) AS sha256 FROM documents")
def h01(spark: SparkSession, sf: str) -> DataFrame:
    x = F.coalesce("text", F.lit(""))
    return spread(table(spark, sf, "documents")).select("doc_id", hashing.md5(x).alias("md5"), hashing.sha1(x).alias("sha1"), hashing.sha256(x).alias("sha256"))


_DIGESTS = "SELECT * FROM (VALUES " + ", ".join(
    f"('{w}', '{hashlib.sha512(w.encode()).hexdigest()}', '{hashing.ntlm_text(w)}')" for w in wordlist.WEAK_PASSWORDS) + ") AS v(plaintext, sha512, ntlm)"


@query("h02_ntlm_sha512", f"SELECT plaintext, md5(plaintext) AS md5, sha1(plaintext) AS sha1, sha256(plaintext) AS sha256, sha512, ntlm FROM ({_DIGESTS})")
def h02(spark: SparkSession, sf: str) -> DataFrame:
    """M-02 in full: every digest of the word list (its SQL has SHA-512 and NTLM as literals)."""
    return wordlist.rainbow_table(wordlist.builtin_words(spark))


@query("h04_row_hash", f"SELECT doc_id, sha256({_FOLD} || '|' || lower(lang) || '|' || lower(source)) AS row_hash FROM documents")
def h04(spark: SparkSession, sf: str) -> DataFrame:
    row = text.normalize_row(F.array("text", "lang", "source"))
    return spread(table(spark, sf, "documents")).select("doc_id", hashing.row_hash(row).alias("row_hash"))


_H05 = {
    "phone": (hashing.hash_phone, "sha256(regexp_replace(value, '[^0-9]', '', 'g'))"),
    "card": (hashing.hash_credit_card, "sha256(right(regexp_replace(value, '[^0-9]', '', 'g'), 4) || '_' || CAST(length(regexp_replace(value, '[^0-9]', '', 'g')) AS STRING))"),
    "ni": (hashing.hash_national_id, "sha256(upper(regexp_replace(value, '[\\s/-]', '', 'g')))"),
    "iban": (hashing.hash_iban, "sha256(upper(regexp_replace(value, '[ -]', '', 'g')))"),
    "swift": (hashing.hash_swift, "sha256(upper(replace(value, '-', '')))"),
    "wallet": (hashing.hash_token, "sha256(lower(trim(value)))"),
}


@query("h05_pii_hashes", f"WITH cells AS ({CELLS_SQL}) SELECT row_id, col_name, CASE col_name " + " ".join(
    f"WHEN '{c}' THEN {q}" for c, (_, q) in _H05.items()) + " END AS hash FROM cells WHERE col_name IN (" + ", ".join(f"'{c}'" for c in _H05) + ")")
def h05(spark: SparkSession, sf: str) -> DataFrame:
    hashed: Column = F.lit(None).cast("string")
    for c, (f, _) in _H05.items():
        hashed = F.when(F.col("col_name") == c, f(F.col("value"))).otherwise(hashed)
    return cells(spark, sf).where(F.col("col_name").isin(*_H05)).select("row_id", "col_name", hashed.alias("hash"))


_FINGER = "CASE c_custkey % 8 WHEN 0 THEN md5(k) WHEN 1 THEN sha1(k) WHEN 2 THEN {sha256} WHEN 3 THEN '$2b$10$' || k WHEN 4 THEN '$7$' || k WHEN 5 THEN '$argon2id$v=19$' || k WHEN 6 THEN ' $pbkdf2-sha256$' || k ELSE k END"


@query("h06_fingerprint", "WITH f AS (SELECT c_custkey, " + _FINGER.format(sha256="sha256(k)") + """ AS v FROM (SELECT c_custkey, CAST(c_custkey AS STRING) AS k FROM customer))
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha1' WHEN 2 THEN 'sha256' WHEN 3 THEN 'bcrypt' WHEN 4 THEN 'scrypt' WHEN 5 THEN 'argon2' WHEN 6 THEN 'pbkdf2' ELSE 'unknown' END AS algorithm,
c_custkey % 8 < 3 AS is_weak, CASE c_custkey % 8 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha1' WHEN 3 THEN 'bcrypt' WHEN 4 THEN 'scrypt' WHEN 5 THEN 'argon2' ELSE 'sha256' END AS compat FROM f""")
def h06(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "customer").selectExpr("c_custkey", "CAST(c_custkey AS STRING) AS k").selectExpr("c_custkey", _FINGER.format(sha256="sha2(k, 256)") + " AS v")
    f, g = hashing.fingerprint(F.col("v")), hashing.fingerprint_compat(F.col("v"))
    return v.select("c_custkey", f["algorithm"].alias("algorithm"), f["is_weak"].alias("is_weak"), g["algorithm"].alias("compat"))


@query("h09_checksum", f"""WITH cells AS ({CELLS_SQL}) SELECT row_id, col_name, 'checksum:' || CAST(coalesce(list_sum(list_transform(range(1, length(value) + 1),
lambda i: ascii(value[i]))), 0) AS STRING) AS checksum FROM cells""")
def h09(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).select("row_id", "col_name", F.element_at(hashing.with_checksum(F.array("value")), 2).alias("checksum"))
