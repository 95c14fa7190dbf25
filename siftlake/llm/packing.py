"""Packing: shortest-pack-first over the length histogram.

Documents are tokenised once and cut into pieces of at most ``size`` ids. Only a histogram of at most ``size`` lengths
reaches the driver; it places lengths from the longest to the shortest, always into the shortest open pack, on counts
of packing patterns. Pieces then meet their place by their rank among the pieces of equal length.

Defined results: a null text is an empty document (one piece: the end id); a null ``doc_id`` is kept as it is; repeated
rows are packed as often as they occur; pieces of equal length take their places in no set order; an empty table gives no
rows; other columns are ignored. Very long texts are encoded one at a time; a worker holds about 30 bytes for each byte of
the longest.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.llm.common import materialize, pieces, tidy
from siftlake.llm.tokens import CACHE_ENTRIES, library_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces of one length that are ranked together: a length is dealt into as many buckets as its count asks for, so that
#: the full pieces of a large corpus are no task's work.
RANKED = 50_000


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, keep_ids: bool = False, entries: int = CACHE_ENTRIES) -> DataFrame:
    """Rows ``PIECES`` (and ``ids`` binary, if kept): documents as ids with the end id, cut at multiples of ``size``."""

    def run(batches):
        encode, end = library_encoder(tokenizer, entries), np.array([end_id], "<u4").tobytes()
        for batch in pieces(batches):
            cols: list[list] = [[], [], [], [], [], []]
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"].to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start : 4 * (start + size)]
                    for c, x in zip(cols, (doc_id, start, len(part) // 4, zlib.crc32(part), n, part), strict=True):
                        c.append(x)
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                arrays.append(pa.array(cols[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(tidy(run, encodes=True), PIECES + (", ids binary" if keep_ids else ""))


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(packs, [(length, times), ...])`` that hold every piece of the histogram exactly once.

    Each length opens or splits at most two groups of equal packs, so there are at most ``2 * size`` groups whatever the
    number of documents.
    """
    open_, done, order = [], [], 0

    def put(used: int, pattern: tuple, packs: int) -> None:
        nonlocal order
        if packs and used == size:
            done.append((packs, pattern))
        elif packs:
            heapq.heappush(open_, (used, order, pattern, packs))
            order += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_ and open_[0][0] + length <= size:
                used, _, pattern, packs = heapq.heappop(open_)
                taken = min(packs, left)
                put(used + length, (*pattern, (length, 1)), taken)
                put(used, pattern, packs - taken)
                left -= taken
            else:
                each = size // length
                packs, rest = divmod(left, each)
                put(each * length, ((length, each),), packs)
                put(rest * length, ((length, rest),), 1 if rest else 0)
                left = 0
    out = done + [(packs, pattern) for _, _, pattern, packs in sorted(open_, key=lambda g: g[:2])]
    merged = []
    for packs, pattern in out:
        times: dict[int, int] = {}
        for length, k in pattern:
            times[length] = times.get(length, 0) + k
        merged.append((packs, sorted(times.items(), reverse=True)))
    return merged


def layout(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Slots of equal length in a row, by pattern: where a rank falls gives its sequence and offset."""
    rows, taken, base = [], {}, 0
    for packs, pattern in patterns:
        offset = 0
        for length, times in pattern:
            first = taken.get(length, 0)
            rows.append(((length << 44) | first, first, base, times, offset))
            taken[length] = first + packs * times
            offset += length * times
        base += packs
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("key", "first", "base", "times", "offset"), cols.T.copy(), strict=True))


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, keep_ids: bool = False, entries: int = CACHE_ENTRIES) -> DataFrame:
    """Pieces with their ``sequence_id`` and gapless ``offset`` in sequences of at most ``size`` ids.

    A worker keeps the ids of up to ``entries`` chunks: fewer take less of its memory and more time.
    """
    spark = docs.sparkSession
    # Numbered before they are written, so that equal pieces of equal documents differ.
    cut = cut_pieces(docs, tokenizer, end_id, size, keep_ids, entries).withColumn("row", F.monotonically_increasing_id())
    pieces = materialize(cut, "pieces")
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    places = spark.sparkContext.broadcast(layout(shortest_pack_first(histogram, size)))

    # An Arrow table of at most ``size`` rows: Python rows would take further workers, with a daemon of their own.
    dealt = {"length": pa.array(list(histogram), pa.int64()), "buckets": pa.array([-(-n // RANKED) for n in histogram.values()], pa.int32())}
    dealt = spark.createDataFrame(pa.table(dealt))
    pieces = pieces.join(F.broadcast(dealt), "length")
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets")).cast("int")).drop("buckets")
    before = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    up_to = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = before.select("length", "bucket", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("row"))
    ranked = pieces.withColumn("within", within).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within") - 1).drop("bucket", "within", "before", "row")

    def run(batches):
        at = places.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            i = np.searchsorted(at["key"], (length.astype(np.int64) << 44) | rank, side="right") - 1
            slot = rank - at["first"][i]
            sequence = at["base"][i] + slot // at["times"][i]
            offset = at["offset"][i] + slot % at["times"][i] * length
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch[n] for n in names] + [pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    schema = PIECES + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*cols, "rank").mapInArrow(run, schema)
