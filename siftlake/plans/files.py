"""Queries that write dumps to files and read them back, and the incremental ingest of a stream of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import events, history, wordlist
from siftlake.plans.source import DUMP_SQL, dump, table
from siftlake.scratch import shared_path
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


def write_text(df: DataFrame, path: str) -> str:
    """One line or document per row of ``value``, as text files."""
    df.select("value").write.option("lineSep", "\n").text(path)
    return path


_TRICKY = ["n_name || ' \"quoted\" '", "'a,b' || CAST(n_nationkey AS STRING)", "'two' || chr(10) || 'lines'"]
_CELLS = "cells[0] AS a, cells[1] AS b, cells[2] AS c"


@query("a01_csv", f"SELECT {_TRICKY[0]} AS a, {_TRICKY[1]} AS b, {_TRICKY[2]} AS c FROM nation")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    quoted = F.array_join(F.transform(F.array(*[F.expr(e) for e in _TRICKY]), lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))), ",")
    path = write_text(table(spark, sf, "nation").select(quoted.alias("value")), shared_path(spark, "csv"))
    return dumps.load_dump(spark, path, "csv").selectExpr("cells[0] AS a", "cells[1] AS b", "cells[2] AS c")


@query("a02_tsv", "SELECT c_name AS a, c_mktsegment AS b, CAST(c_custkey AS STRING) AS c FROM customer")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws("\t", "c_name", "c_mktsegment", F.col("c_custkey").cast("string"))
    path = write_text(table(spark, sf, "customer").select(line.alias("value")), shared_path(spark, "tsv"))
    return dumps.load_lines(spark, path, "tsv").selectExpr("cells[0] AS a", "cells[1] AS b", "cells[2] AS c")


@query("a03_a04_json", "SELECT CAST(n_nationkey AS STRING) AS key, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS STRING) ELSE '' END AS region FROM nation UNION ALL SELECT 'k', 'v.name', 'v.region'")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document: an array of nested objects of which half lack a key; the first row is the header."""
    region = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(',"region":'), "n_regionkey")).otherwise("")
    one = F.concat(F.lit('{"k":'), "n_nationkey", F.lit(',"v":{"name":"'), "n_name", F.lit('"'), region, F.lit("}}"))
    doc = table(spark, sf, "nation").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value"))
    path = write_text(doc, shared_path(spark, "json"))
    return dumps.load_dump(spark, path, "json").selectExpr("cells[0] AS key", "cells[1] AS name", "cells[2] AS region")


@query("a07_xml", "SELECT 'nation id=\"' || CAST(n_nationkey AS STRING) || '\"' AS tag, n_name AS body FROM nation")
def a07(spark: SparkSession, sf: str) -> DataFrame:
    element = F.concat(F.lit('<nation id="'), "n_nationkey", F.lit('"> '), "n_name", F.lit(" </nation>"))
    doc = table(spark, sf, "nation").agg(F.concat(F.lit("<?xml version='1.0'?><all>"), F.array_join(F.collect_list(element), "\n"), F.lit("</all>")).alias("value"))
    path = write_text(doc, shared_path(spark, "xml"))
    return dumps.load_dump(spark, path, "xml").selectExpr("cells[0] AS tag", "cells[1] AS body")


@query("a08_csv_lines", "SELECT c_name AS a, 'x \"y\", z' AS b, CAST(NULL AS VARCHAR) AS error FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT NULL, NULL, 'quote within a field' FROM customer WHERE c_custkey % 10 = 0")
def a08(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("c_custkey") % 10 == 0, 'bad"quote,1').otherwise(F.concat("c_name", F.lit(',"x ""y"", z"')))
    path = write_text(table(spark, sf, "customer").select(line.alias("value")), shared_path(spark, "lines"))
    return dumps.load_lines(spark, path, "csv").selectExpr("cells[0] AS a", "cells[1] AS b", "error")


@query("a11_statistics", "SELECT count(*) FILTER (c_custkey % 10 <> 0) AS rows_processed, count(*) FILTER (c_custkey % 10 = 0) AS rows_failed, CAST(sum(CASE WHEN c_custkey % 10 = 0 THEN 12 ELSE strlen(c_name) + 14 END) AS BIGINT) AS bytes_read, 'quote within a field' AS warnings FROM customer")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("c_custkey") % 10 == 0, 'bad"quote,1').otherwise(F.concat("c_name", F.lit(',"x ""y"", z"')))
    path = write_text(table(spark, sf, "customer").coalesce(1).select(line.alias("value")), shared_path(spark, "lines"))
    stats = dumps.parse_statistics(dumps.load_lines(spark, path, "csv"))
    return stats.select("rows_processed", "rows_failed", "bytes_read", F.array_join("warnings", ",").alias("warnings"))


@query("a09_json_lines", "SELECT 'id:' || CAST(event_id AS STRING) AS a, 'type:\"' || event_type || '\"' AS b FROM events")
def a09(spark: SparkSession, sf: str) -> DataFrame:
    line = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id")))
    path = write_text(table(spark, sf, "events").select(line.alias("value")), shared_path(spark, "jsonl"))
    return dumps.load_lines(spark, path, "jsonl").selectExpr("cells[0] AS a", "cells[1] AS b")


@query("m01_words", "SELECT DISTINCT lower(c_mktsegment) AS plaintext FROM customer")
def m01(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "customer").select(F.explode(F.array(F.lit("# comment"), F.lit(""), F.concat(F.lit("  "), F.lower("c_mktsegment")))).alias("value"))
    return wordlist.load_words(spark, write_text(lines, shared_path(spark, "words")))


_COUNTS = DUMP_SQL + """, fr AS (SELECT row_hash, min(row_idx) AS r FROM good GROUP BY 1)
SELECT 'malformed_row' AS event_type, count(*) AS n FROM dump WHERE malformed
UNION ALL SELECT 'new_address', count(DISTINCT address_hash) FROM good UNION ALL SELECT 'address_hash', count(DISTINCT address_hash) FROM good
UNION ALL SELECT 'credential_hash', count(DISTINCT credential_hash) FROM good
UNION ALL SELECT 'addr_cred', count(*) FROM (SELECT DISTINCT address_hash, credential_hash FROM good)
UNION ALL SELECT 'known_address_new_credential', (SELECT count(*) FROM (SELECT DISTINCT address_hash, credential_hash FROM good)) - (SELECT count(DISTINCT address_hash) FROM good)
UNION ALL SELECT 'row', count(*) FROM fr UNION ALL SELECT 'duplicate_row', (SELECT count(*) FROM good) - (SELECT count(*) FROM fr)"""


@query("g15_g20_store", _COUNTS)
def g20(spark: SparkSession, sf: str) -> DataFrame:
    """The event log put into a store twice, exported and imported into another one: still one of each event."""
    a, b, out = (shared_path(spark, n) for n in ("store", "store", "export"))
    log = events.event_log(dump(spark, sf))
    first = history.HistoryStore(spark, a)
    first.insert_events(log, "dump")
    first.insert_events(log, "dump")
    first.export(out)
    second = history.HistoryStore(spark, b)
    second.import_(out)
    return second.read("normalized_rows").groupBy("event_type").agg(F.count("*").alias("n"))


@query("j02_stream_ingest", _COUNTS)
def j02(spark: SparkSession, sf: str) -> DataFrame:
    """The dump as a stream of files, one a batch, through ``foreachBatch`` into a store; totals are those of the whole."""
    source, store, checkpoint = (shared_path(spark, n) for n in ("stream", "store", "checkpoint"))
    rows = dump(spark, sf)
    rows.repartitionByRange(3, "row_idx").sortWithinPartitions("row_idx").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    kept = history.HistoryStore(spark, store)
    incremental.ingest_stream(stream, kept, "stream", checkpoint).awaitTermination()
    return kept.read("normalized_rows").groupBy("event_type").agg(F.count("*").alias("n"))
