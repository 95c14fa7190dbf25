"""Vector similarity of addresses: exact cosine in blocks that meet in pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Stored vectors and queries that meet in one task.
BLOCK = 4096


def cosine(a: Column, b: Column) -> Column:
    """G-10: in double precision; null where lengths differ or a norm is zero."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), total(a, b) / norms)


def find_similar(stored: DataFrame, queries: DataFrame, threshold: float = 0.85, limit: int = 5, blocks: int | None = None) -> DataFrame:
    """G-09: ``query_id, id, similarity`` of the ``limit`` best at or above ``threshold``, ties by id.

    ``stored`` and ``queries``: ``id`` (long or string) and ``embedding``; vectors that are null, empty, zero or hold null or
    non-finite components take no part. Both sides are dealt by length into blocks that meet in pairs, as matrices; a
    block pair keeps its ``limit`` best for each query before anything is shuffled. The work is queries x stored; blocks
    of equal size ship least.
    """
    kind = "string" if stored.schema["id"].dataType.simpleString() == "string" else "long"
    ids_of = lambda column: column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col("id").cast(kind), F.col("embedding").cast("array<double>").alias("v"))
        return df.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0)).withColumn("w", F.size("v"))

    stored, queries = clean(stored), clean(queries)
    n = blocks or max(1, -(-stored.count() // BLOCK))
    m = blocks or max(1, -(-queries.count() // BLOCK))
    deal = lambda df, k, s: df.withColumn(s, F.pmod(F.xxhash64("id"), F.lit(k)).cast("int"))
    left = deal(stored, n, "a").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = deal(queries, m, "b").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def unit(column: pa.ChunkedArray, n: int) -> np.ndarray:
        x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def meet(x: pa.Table, q: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "id", "similarity"], [*[pa.string() if kind == "string" else pa.int64()] * 2, pa.float64()]
        out = [np.zeros(0)] * 3
        if len(x) and len(q):
            x = x.sort_by("id")  # equal similarities go to the smaller id
            xs, ids, asked = unit(x["v"], len(x)), ids_of(x["id"]), ids_of(q["id"])
            found = []
            for at in range(0, len(q), 256):
                part = asked[at : at + 256]
                s = unit(q["v"].slice(at, 256), len(part)) @ xs.T
                s[part[:, None] == ids[None, :]] = -2
                order = np.argsort(-s, axis=1, kind="stable")[:, :limit]
                best = np.take_along_axis(s, order, 1)
                row, place = np.nonzero(best >= threshold)
                found.append((part[row], ids[order[row, place]], best[row, place]))
            out = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table([pa.array(c.tolist(), k) for c, k in zip(out, kinds, strict=True)], names=names)

    key = ["w", "a", "b"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, f"query_id {kind}, id {kind}, similarity double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return near.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def find_duplicates(probe: DataFrame, known: DataFrame, threshold: float = 0.85) -> DataFrame:
    """G-11: ``id, duplicate_of, how``: the least known row of the same hash, else the most similar one.

    ``probe`` and ``known``: ``id, address_hash, embedding``. A row is no duplicate of itself, so that the probes may be
    known rows.
    """
    least = known.groupBy("address_hash").agg(F.min("id").alias("least"))
    after = known.select("address_hash", "id").join(least, "address_hash").where("id > least")
    after = after.groupBy("address_hash").agg(F.min("id").alias("after"))
    exact = probe.select("id", "address_hash").join(least, "address_hash").join(after, "address_hash", "left")
    exact = exact.select("id", F.when(F.col("id") != F.col("least"), F.col("least")).otherwise(F.col("after")).alias("duplicate_of"))
    exact = exact.where("duplicate_of IS NOT NULL").withColumn("how", F.lit("hash"))
    left = probe.join(exact, "id", "left_anti")
    similar = find_similar(known.select("id", "embedding"), left.select("id", "embedding"), threshold, 1)
    return exact.union(similar.select(F.col("query_id").alias("id"), F.col("id").alias("duplicate_of"), F.lit("similar").alias("how")))
