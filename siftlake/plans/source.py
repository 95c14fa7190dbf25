"""Deterministic cells and dumps derived from the star-schema tables, as expressions both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.scratch import spread

_K = "CAST(c_custkey AS STRING)"

#: Column name to expression over ``customer``.
CELLS = {
    "email": "lower(replace(c_name, '#', '.')) || '@example.com'",
    "alt_email": f"'  U.' || lpad({_K}, 4, '0') || '+tag@GoogleMail.com '",
    "phone": f"'+1-555-' || lpad({_K}, 7, '0')",
    "mobile": f"lpad({_K}, 10, '5')",
    "ssn": f"'123-45-' || lpad({_K}, 4, '0')",
    "card": f"'411111111111' || lpad({_K}, 4, '0')",
    "card2": f"'5500 0000 00' || lpad({_K}, 6, '0')",
    "iban": f"'DE89 3704 0044 0532 ' || lpad({_K}, 6, '0')",
    "swift": "'DEUT' || substr(c_mktsegment, 1, 2) || 'FF'",
    "routing": f"lpad({_K}, 9, '0')",
    "account": f"lpad({_K}, 12, '7')",
    "ni": f"'AB' || lpad({_K}, 6, '0') || 'C'",
    "dni": f"lpad({_K}, 8, '0') || 'X'",
    "cf": f"'RSSMRA80A01A' || lpad({_K}, 3, '0') || 'Q'",
    "cn_id": f"lpad({_K}, 18, '1')",
    "full_name": "'John ' || c_mktsegment",
    "user": "c_name",
    "address": f"{_K} || ' Main Street'",
    "btc": f"'1A1zPeagoat5GkjM7E6vfj4FPV' || lpad({_K}, 4, '2')",
    "eth": f"'0x742d35Cc6634C0532925a3b844Bc9e7595f4' || lpad({_K}, 4, '0')",
    "wallet": f"'acct_' || lpad({_K}, 10, '0')",
    "token": f"'GPAY_TOKEN_' || lpad({_K}, 10, '0')",
    "ipv4": "CAST(c_custkey % 256 AS STRING) || '.' || CAST(c_custkey % 200 AS STRING) || '.0.' || CAST(c_custkey % 300 AS STRING)",
    "ipv6": "'2001:db8::' || CAST(c_custkey % 10000 AS STRING)",
    "hash": f"md5({_K})",
    "password": f"CASE WHEN c_custkey % 5 = 0 THEN 'password' WHEN c_custkey % 5 = 1 THEN '123456' ELSE 'pw-' || {_K} END",
    "blank": "''",
}

#: SQL of the same cells: ``row_id, col_name, value``.
CELLS_SQL = (
    "SELECT c_custkey AS row_id, unnest([" + ", ".join(f"'{c}'" for c in CELLS) + "]) AS col_name, unnest(["
    + ", ".join(CELLS.values()) + "]) AS value FROM customer"
)
#: With trimmed value and digits.
TRIMMED_SQL = (
    f"WITH cells AS ({CELLS_SQL}), t AS (SELECT *, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS v FROM cells), "
    "c AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM t) "
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, col_name, value``."""
    stack = f"stack({len(CELLS)}, " + ", ".join(f"'{c}', {e}" for c, e in CELLS.items()) + ") AS (col_name, value)"
    return spread(table(spark, sf_dir, "customer")).selectExpr("c_custkey AS row_id", stack)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, value``: the tokens of all documents between ASCII blanks."""
    docs = spread(table(spark, sf_dir, "documents"))
    each = F.explode(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+")).alias("value")
    return docs.select("doc_id", "lang", each).where("value <> ''")


TOKENS_SQL = (
    "SELECT doc_id, lang, value FROM (SELECT doc_id, lang, unnest(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+')) "
    "AS value FROM documents) WHERE value <> ''"
)

#: A credential dump in order of ``row_idx``; every 97th row lacks a cell.
DUMP_CELLS = [
    "'Cust' || CAST(o_custkey % 500 AS STRING) || '@Example.com'",
    "'user' || CAST(o_custkey % 700 AS STRING)",
    "'pw' || CAST(o_custkey % 37 + o_orderkey % 3 AS STRING)",
]


def dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_seq, file_id, row_idx, cells, header`` of the dump."""
    full = "array(" + ", ".join(DUMP_CELLS) + ")"
    return spread(table(spark, sf_dir, "orders")).selectExpr(
        "CAST(0 AS BIGINT) AS file_seq", "'dump' AS file_id", "o_orderkey AS row_idx",
        f"CASE WHEN o_orderkey % 97 = 0 THEN slice({full}, 1, 2) ELSE {full} END AS cells",
        "array('email', 'username', 'password') AS header",
    )


DUMP_SQL = (
    "WITH dump AS (SELECT o_orderkey AS row_idx, o_orderkey % 97 = 0 AS malformed, lower(" + DUMP_CELLS[0] + ") AS email, "
    + DUMP_CELLS[1] + " AS username, " + DUMP_CELLS[2] + " AS password FROM orders), good AS (SELECT row_idx, "
    "sha256(email) AS address_hash, sha256(password) AS credential_hash, "
    "sha256(email || '|' || username || '|' || password) AS row_hash, email, username, password FROM dump WHERE NOT malformed) "
)
