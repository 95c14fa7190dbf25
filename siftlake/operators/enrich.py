"""Enrichment from tables: breaches of new addresses, precomputed embeddings, custom plugins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.operators.events import event_log
from siftlake.operators.history import HistoryStore
from siftlake.operators.similar import find_similar
from siftlake.scratch import written


def breach_summary(addresses: DataFrame, breaches: DataFrame) -> DataFrame:
    """M-11, F-13: ``address_hash, is_breached, breach_count, pwn_count, last_breach`` from an offline breach table."""
    b = breaches.groupBy(F.col("canonical_hash").alias("address_hash")).agg(
        F.count_distinct("breach_name").alias("breach_count"), F.sum("pwn_count").alias("pwn_count"), F.max("breach_date").alias("last_breach")
    )
    out = addresses.select("address_hash").distinct().join(b, "address_hash", "left")
    return out.na.fill(0, ["breach_count", "pwn_count"]).withColumn("is_breached", F.col("breach_count") > 0)


def new_credential_since_breach(pairs: DataFrame, breaches: DataFrame) -> DataFrame:
    """Pairs first seen more than a day after the last breach of their address."""
    last = breaches.groupBy(F.col("canonical_hash").alias("address_hash")).agg(F.max("breach_date").alias("last_breach"))
    out = pairs.join(last, "address_hash")
    return out.where(F.col("first_seen_at").cast("date") > F.date_add("last_breach", 1))


def with_embeddings(addresses: DataFrame, embeddings: DataFrame) -> DataFrame:
    """F-12: precomputed ``embedding`` by ``address_hash`` (no service is called)."""
    return addresses.join(embeddings.select("address_hash", "embedding"), "address_hash", "left")


@dataclass(frozen=True)
class Enrichment:
    """F-15: what is added to new addresses."""

    embeddings: bool = False
    breaches: bool = False
    similarity: float = 0.85
    most_similar: int = 5


def ingest_enriched(store: HistoryStore, rows: DataFrame, dataset: str, settings: Enrichment | None = None,
                    embeddings: DataFrame | None = None, breaches: DataFrame | None = None) -> dict[str, DataFrame]:
    """F-12, F-13: events of ``rows`` into ``store``, with what tables say of their new addresses.

    With ``settings.embeddings`` new addresses get the vector that ``embeddings`` (``address_hash, embedding``) holds and
    become canonical addresses; ``similar`` are the most similar addresses that the store held before. With
    ``settings.breaches`` the rows of ``breaches`` (as ``address_breaches``) of new addresses are inserted. Returns
    ``events`` and, where asked for, ``similar`` (``query_id, id, similarity``) and ``breached`` (M-11).
    """
    settings = settings or Enrichment()
    log = written(event_log(rows, store.known()), "events")
    store.insert_events(log, dataset)
    out = {"events": log}
    new = log.where("event_type = 'new_address'").select("address_hash").distinct()
    if settings.embeddings and embeddings is not None:
        known = written(store.read("canonical_addresses").select(F.col("canonical_hash").alias("id"), "embedding"), "known-vectors")
        named = written(with_embeddings(new, embeddings), "new-vectors")
        store.insert("canonical_addresses", named.withColumnRenamed("address_hash", "canonical_hash"))
        asked = named.select(F.col("address_hash").alias("id"), "embedding")
        out["similar"] = find_similar(known, asked, settings.similarity, settings.most_similar)
    if settings.breaches and breaches is not None:
        of_new = breaches.join(new.withColumnRenamed("address_hash", "canonical_hash"), "canonical_hash", "left_semi")
        store.insert("address_breaches", of_new)
        out["breached"] = breach_summary(new, store.read("address_breaches"))
    return out


def apply_plugins(rows: DataFrame, plugins: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """K-03: row enrichers as DataFrame functions, in order."""
    for plugin in plugins:
        rows = rows.transform(plugin)
    return rows


def percentiles(values: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Latency percentiles: exact order statistics as one row."""
    return values.agg(*[F.expr(f"percentile_disc({p}) within group (order by `{column}`)").alias(f"p{round(100 * p)}") for p in shares])
