"""The history store: versioned Parquet tables with insert-ignore, probes, neighbours, statistics, export and import.

A table is a folder of versions; an insert writes only the new rows as a further version, so that nothing is rewritten.
Readers take versions whose write has ended (Spark's success marker), so that they never see half a write. Inserts into
one table have to come one after another: two at once may both insert a key. Probes are semi and anti joins over whole
key columns, which Spark prunes and, for small sides, broadcasts by measured size.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.schema import TABLES


def insert_ignore(existing: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    """G-04: the rows of ``new`` to insert: one for each key that ``existing`` lacks (the least row wins)."""
    columns = new.columns
    rest = F.min(F.struct(*[c for c in columns if c not in key])).alias("__rest") if len(columns) > len(key) else F.count("*").alias("__n")
    fresh = new.groupBy(*key).agg(rest)
    fresh = fresh.select(*[F.col(c) if c in key else F.col(f"__rest.{c}").alias(c) for c in columns])
    return fresh if existing is None else fresh.join(existing.select(*key), key, "left_anti")


class HistoryStore:
    """K-02: tables of ``siftlake.schema`` under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self, table: str) -> list[str]:
        """The paths of all versions that are whole."""
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(x.getPath().getParent().toString() for x in found or [])

    def read(self, table: str, without: str | None = None) -> DataFrame:
        """All rows, or those of all versions but that named ``without``."""
        schema = TABLES[table][0]
        paths = [p for p in self.versions(table) if p.rpartition("/")[2] != f"v-{without}"]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def insert(self, table: str, rows: DataFrame, version: str | None = None) -> int:
        """Insert-ignore by primary key; returns how many rows went in.

        A ``version`` that is there already is written anew against the others, so that a repeated batch replaces its own
        rows.
        """
        schema, key = TABLES[table]
        wanted = self.spark.createDataFrame([], schema)
        rows = rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.schema
        ])
        path = f"{self.path}/{table}/v-{version or uuid.uuid4().hex}"
        insert_ignore(self.read(table, version), rows, key).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path).count()

    def insert_events(self, events: DataFrame, dataset: str, version: str | None = None) -> int:
        """An event log as ``normalized_rows``: the id is a digest of the event, so that a repeated write adds nothing."""
        identity = F.sha2(F.to_json(F.struct(F.lit(dataset), *[F.col(c) for c in events.columns])), 256)
        rows = events.withColumns({"id": identity, "dataset": F.lit(dataset), "source_file": F.col("file_id")})
        return self.insert("normalized_rows", rows, version)

    def known(self, without: str | None = None) -> dict[str, DataFrame]:
        """The history for ``event_log``, without the rows of one version."""
        from siftlake.operators.events import history_of

        return history_of(self.read("normalized_rows", without))

    def aliases_of(self, probe: DataFrame) -> DataFrame:
        """G-13: the alias relationships of the canonical hashes in ``probe``."""
        return self.read("alias_relationships").join(probe.select("canonical_hash").distinct(), "canonical_hash", "left_semi")

    def anomalies_of(self, probe: DataFrame) -> DataFrame:
        """G-13: the anomaly scores of the files in ``probe``."""
        return self.read("anomaly_scores").join(probe.select("file_id").distinct(), "file_id", "left_semi")

    def stats(self) -> DataFrame:
        return db_stats({t: self.read(t) for t in TABLES})

    def export(self, path: str) -> None:
        """G-18: every table as JSON lines below ``path`` and a manifest."""
        for t in TABLES:
            self.read(t).write.mode("overwrite").json(f"{path}/{t}")
        rows = [json.dumps({"version": "1.0.0", "tables": sorted(TABLES)})]
        self.spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    def import_(self, path: str) -> dict[str, dict[str, int]]:
        """G-20: insert-ignore of an export; counts of imported and skipped rows by table."""
        out = {}
        for t, (schema, _) in TABLES.items():
            rows = self.spark.read.schema(schema).json(f"{path}/{t}")
            total, put = rows.count(), self.insert(t, rows)
            out[t] = {"imported": put, "skipped": total - put}
        return out


def address_exists(probe: DataFrame, addresses: DataFrame, exists: bool = True) -> DataFrame:
    """G-01."""
    return probe.join(addresses.select("address_hash"), "address_hash", "left_semi" if exists else "left_anti")


def address_has_credential(probe: DataFrame, pairs: DataFrame, exists: bool = True) -> DataFrame:
    """G-02."""
    key = ["address_hash", "credential_hash"]
    return probe.join(pairs.select(*key), key, "left_semi" if exists else "left_anti")


def contains_hash(probe: DataFrame, rows: DataFrame) -> DataFrame:
    """G-03: probes (``hash``) found exactly in any hash column of the event rows."""
    hashes = rows.select(F.explode(F.array("address_hash", "credential_hash", "row_hash")).alias("hash")).where("hash IS NOT NULL").distinct()
    return probe.join(hashes, "hash", "left_semi")


def canonical_of(alternates: DataFrame, probe: DataFrame) -> DataFrame:
    """G-05: ``alternate_hash, canonical_hash`` of known alternates."""
    return probe.join(alternates.select("alternate_hash", "canonical_hash"), "alternate_hash")


#: Nodes of a group on either side of a join that meet under one key.
BLOCK = 256


def cooccurrence(occurrences: DataFrame, group: list[str], node: str = "address_hash", most: int | None = None) -> DataFrame:
    """G-07: undirected edges ``canonical_hash_1 < canonical_hash_2`` with counts, from nodes that share a group.

    All pairs of every group are counted. The nodes of a group of more than ``BLOCK`` are dealt into blocks that meet in
    pairs under keys of their own, so that no task gets a whole group. Only where a caller names ``most``, groups of more
    nodes are reduced to links with their smallest node, which keeps them connected but not their counts.
    """
    own = occurrences.select(*group, F.col(node).alias("n")).where(F.col(node).isNotNull()).distinct()
    sized = own.groupBy(*group).agg(F.count("*").alias("size"), F.min("n").alias("least"))
    whole = sized.where("size > 1") if most is None else sized.where(f"size BETWEEN 2 AND {most}")
    blocks = whole.select(*group, F.ceil(F.col("size") / BLOCK).cast("int").alias("__blocks"))
    dealt = own.join(blocks, group).withColumn("__own", F.pmod(F.xxhash64("n"), F.col("__blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    a = dealt.select(*group, F.col("n").alias("canonical_hash_1"), F.col("__own").alias("__x"), every.alias("__y"))
    b = dealt.select(*group, F.col("n").alias("canonical_hash_2"), F.col("__own").alias("__y"), every.alias("__x"))
    pairs = a.join(b, [*group, "__x", "__y"]).where("canonical_hash_1 < canonical_hash_2").select("canonical_hash_1", "canonical_hash_2")
    if most is not None:
        star = own.join(sized.where(f"size > {most}"), group).where("n > least")
        pairs = pairs.union(star.select(F.col("least").alias("canonical_hash_1"), F.col("n").alias("canonical_hash_2")))
    return pairs.groupBy("canonical_hash_1", "canonical_hash_2").agg(F.count("*").alias("cooccurrence_count"))


def neighbors(edges: DataFrame) -> DataFrame:
    """G-08: ``node, neighbor, cooccurrence_count`` in both directions."""
    flip = edges.select(F.col("canonical_hash_2").alias("node"), F.col("canonical_hash_1").alias("neighbor"), "cooccurrence_count")
    return edges.select(F.col("canonical_hash_1").alias("node"), F.col("canonical_hash_2").alias("neighbor"), "cooccurrence_count").union(flip)


def distinct_credentials(rows: DataFrame) -> DataFrame:
    """G-19: ``credential_hash, created_at``: each credential with its latest time."""
    return rows.where("credential_hash IS NOT NULL").groupBy("credential_hash").agg(F.max("created_at").alias("created_at"))


def plain_fields(fields: Column) -> Column:
    """G-16: event fields as a JSON array, without those that only tag the event's origin."""
    return F.to_json(F.filter(fields, lambda x: ~x.rlike("^(file_id|source_file|row_hash):")))


def high_risk(anomalies: DataFrame, threshold: int) -> DataFrame:
    """G-13."""
    return anomalies.where(F.col("risk_score") > threshold)


def db_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """G-14: one row of counts, averages and the two most frequent keys (ties by name)."""
    one = lambda df, expr: df.agg(expr.alias("x")).scalar()
    n = F.count("*")

    def top(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(n.alias("n")).orderBy(F.desc("n"), key).limit(1)

    breach, busiest = top(tables["address_breaches"], "breach_name"), top(tables["address_credentials"], "canonical_hash")
    base = tables["canonical_addresses"].agg(n.alias("total_addresses"))
    out = base.withColumns({
        "total_variants": one(tables["address_alternates"], n),
        "total_credentials": one(tables["address_credentials"], F.count_distinct("credential_hash")),
        "total_address_credentials": one(tables["address_credentials"], n),
        "total_cooccurrences": one(tables["address_cooccurrence"], n),
        "total_breaches": one(tables["address_breaches"], n),
        "total_rows": one(tables["normalized_rows"], n),
        "unique_datasets": one(tables["normalized_rows"], F.count_distinct("dataset")),
        "top_breach": breach.select("breach_name").scalar(), "top_breach_count": breach.select("n").scalar(),
        "top_address": busiest.select("canonical_hash").scalar(), "top_address_count": busiest.select("n").scalar(),
    })
    each = lambda c: F.when(F.col("total_addresses") > 0, F.col(c) / F.col("total_addresses")).otherwise(F.lit(0.0))
    return out.withColumns({
        "avg_credentials_per_address": each("total_address_credentials"), "avg_variants_per_address": each("total_variants"),
    })
