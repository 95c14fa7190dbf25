"""Token-id store: raw id shards in ascending key order and a minimal perfect hash index over their documents.

A store is a folder: ``shard-*.ids`` (16 bytes of header, then ids of 2 or 4 bytes), ``index-*.mph`` (documents dealt
out by hash; each file maps a key to its entry in constant time and keeps a fingerprint of it), ``manifest.parquet``.
Tasks write under names of their own attempt; only files named in the manifest count, so that repeated or lost tasks
leave no trace in what is read.

Defined results: a null text is empty (the end id only); null keys and repeated keys are stored and found by their
occurrence number; an id that does not fit the width raises; an empty table gives a store without shards; other columns
are ignored. Very long texts are encoded one at a time; a worker holds about 30 bytes for each byte of the longest.
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.llm.common import filesystem, materialize, pieces
from siftlake.llm.tokens import library_encoder

MAGIC = b"SIFTIDS1"
HEADER = 16
#: Documents for each index file.
INDEX_KEYS = 200_000
GAMMA = 2.0
LEVELS = 32
#: Seeds tried until the keys of an index file differ in 64 bits; a second one is needed about once in a thousand million.
SEEDS = 64
#: Occurrences of one doc_id that are spelled out together.
RUN = 65_536


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of multiplications and shifts."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Keys (unsigned 64-bit, distinct) to 0..n-1: a cascade of bit arrays; keys alone on their bit are placed there."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks = [np.cumsum(bits) - bits for bits in (x.astype(np.int64) for x in levels)]
        self.bases = np.cumsum([0, *(int(x.sum()) for x in levels)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left) and len(levels) < LEVELS:
            size = max(64, int(len(left) * GAMMA))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, np.sort(left))  # what no level placed (next to never) is found by bisection

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (_mix(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.bases[k] + self.ranks[k][at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            i = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[i] == keys[open_]
            out[open_[hit]] = self.bases[-1] + i[hit]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        packed = {f"level{k}": np.packbits(x) for k, x in enumerate(self.levels)}
        return packed | {"sizes": np.array([len(x) for x in self.levels], np.int64), "rest": self.rest}

    @classmethod
    def load(cls, saved) -> PerfectHash:
        levels = [np.unpackbits(saved[f"level{k}"], count=int(n)).astype(bool) for k, n in enumerate(saved["sizes"])]
        return cls(levels, saved["rest"])


def hashes(doc_id: pa.ChunkedArray, nth: pa.ChunkedArray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys and 32-bit fingerprints of the keys (``doc_id``, ``nth``)."""
    values = doc_id.fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
    first = _mix(values, seed) ^ _mix(doc_id.is_null().to_numpy().astype(np.uint64), seed + 1)
    key = _mix(first ^ _mix(nth.to_numpy().astype(np.int64).view(np.uint64), seed + 2), seed + 3)
    return key, (_mix(key ^ values, seed + 4) >> np.uint64(32)).astype(np.uint32)


def distinct_hashes(doc_id: pa.ChunkedArray, nth: pa.ChunkedArray) -> tuple[int, np.ndarray, np.ndarray]:
    """A seed by which the keys differ in their 64 bits, and their hashes; raises where a key occurs twice."""
    for seed in range(0, 8 * SEEDS, 8):
        key, fingerprint = hashes(doc_id, nth, seed)
        if len(np.unique(key)) == len(key):
            return seed, key, fingerprint
    raise ValueError("keys of an index are not distinct")


def with_part(df: DataFrame, parts: int) -> DataFrame:
    """Adds the index file ``part`` of the key (``doc_id``, ``nth``)."""
    key = [F.col("doc_id").isNull().cast("int"), F.coalesce("doc_id", F.lit(0)), F.col("nth").cast("long")]
    return df.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))


def shard_ids(ids: np.ndarray, width: int) -> bytes:
    """``ids`` as unsigned integers of ``width`` bytes; raises where one does not fit."""
    if len(ids) and int(ids.max()) >> (8 * width):
        raise OverflowError(f"id {int(ids.max())} does not fit into {width} bytes")
    return ids.astype(f"<u{width}").tobytes()


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int | None = None) -> DataFrame:
    """Encode ``docs`` into a store at ``path``; returns its manifest.

    Ids take ``width`` bytes, without it 2 where all ids of the tokenizer and ``end_id`` fit, else 4.
    """

    def shard(batches):
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        pid = TaskContext.get().partitionId()
        name = f"shard-{pid:06d}-{uuid.uuid4().hex[:8]}.ids"
        encode, end, out = library_encoder(tokenizer), np.array([end_id], "<u4").tobytes(), None
        size = width or (2 if max(encode.largest_id, end_id) < 1 << 16 else 4)
        offset, nth, last = 0, 0, object()
        try:
            for batch in pieces(batches):
                rows: list[tuple] = []
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"].to_pylist()), strict=True):
                    if out is None:
                        out = fs.open_output_stream(f"{root}/{name}")
                        out.write(MAGIC + size.to_bytes(8, "little"))
                    ids = np.frombuffer(ids + end, "<u4")
                    out.write(shard_ids(ids, size))
                    nth, last = (nth + 1 if doc_id == last else 0), doc_id
                    rows.append((pid, name, doc_id, nth, offset, len(ids)))
                    offset += len(ids)
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
                names = ["shard", "file", "doc_id", "nth", "offset", "n"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        finally:
            if out is not None:
                out.close()

    # The row's number splits a doc_id (or null) that holds many rows over several ranges.
    ordered = docs.select(F.col("doc_id").cast("long"), "text").withColumn("row", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    entries = materialize(
        ordered.mapInArrow(shard, "shard int, file string, doc_id long, nth long, offset long, n long"), "ids-entries"
    )
    shards = entries.groupBy("shard", "file").agg(F.count("*").alias("documents"), F.sum("n").alias("ids"))
    before = F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    shards = shards.withColumn("base", F.coalesce(before, F.lit(0)))  # one row for each shard file
    shards.coalesce(1).write.parquet(f"{path}/manifest.parquet")
    manifest = docs.sparkSession.read.parquet(f"{path}/manifest.parquet")
    parts = max(1, -(-(manifest.agg(F.sum("documents")).first()[0] or 0) // INDEX_KEYS))

    # A doc_id that goes on in a further shard is that shard's first: occurrences before it are added to its numbers.
    heads = entries.where("offset = 0").select(F.col("doc_id").alias("head")).distinct()  # at most one row for each shard
    runs = entries.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left_semi")
    runs = runs.groupBy(F.col("doc_id").alias("head"), F.col("shard").alias("at")).agg(F.count("*").alias("k"))
    earlier = F.sum("k").over(W.partitionBy("head").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("earlier", earlier).where("earlier > 0").drop("k")  # at most one row for each shard
    same = (F.col("shard") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("head"))
    entries = entries.join(F.broadcast(runs), same, "left").withColumn("nth", F.col("nth") + F.coalesce("earlier", F.lit(0)))

    def index(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        seed, keys, fingerprint = distinct_hashes(table["doc_id"], table["nth"])
        hashed = PerfectHash.build(keys)
        slot, n = hashed(keys), len(keys)
        saved = hashed.arrays() | {"seed": np.array([seed]), "fingerprint": np.empty(n, np.uint32)}
        saved["fingerprint"][slot] = fingerprint
        for name, kind in (("shard", np.int32), ("offset", np.int64), ("n", np.int64)):
            saved[name] = np.empty(n, kind)
            saved[name][slot] = table[name].to_numpy().astype(kind)
        fs, root = filesystem(path)
        name = f"index-{part:06d}-{uuid.uuid4().hex[:8]}.mph"
        data = io.BytesIO()
        np.savez(data, **saved)
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(data.getvalue())
        return pa.table({"part": pa.array([part], pa.int32()), "index_file": [name]})

    dealt = with_part(entries.select("doc_id", "nth", "shard", "offset", "n"), parts)
    built = dealt.groupBy("part").applyInArrow(index, "part int, index_file string")
    built.coalesce(1).write.parquet(f"{path}/index.parquet")
    return manifest


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """``doc_id, nth, shard, offset, n`` of those ``keys`` (``doc_id``, ``nth``) that the index holds."""
    files = spark.read.parquet(f"{path}/index.parquet")
    parts = max(1, files.count())
    names = files.select(F.col("part"), "index_file")

    def find(table: pa.Table) -> pa.Table:
        fs, root = filesystem(path)
        with fs.open_input_stream(f"{root}/{table['index_file'][0].as_py()}") as f:
            saved = dict(np.load(io.BytesIO(f.read())))
        key, fingerprint = hashes(table["doc_id"], table["nth"], int(saved["seed"][0]))
        slot = PerfectHash.load(saved)(key)
        there = slot >= 0
        there[there] = saved["fingerprint"][slot[there]] == fingerprint[there]
        table, slot = table.filter(pa.array(there)), slot[there]
        out = {"doc_id": table["doc_id"], "nth": table["nth"]}
        return pa.table(out | {k: pa.array(saved[k][slot]) for k in ("shard", "offset", "n")})

    asked = with_part(keys, parts).join(F.broadcast(names), "part")  # one row for each INDEX_KEYS documents
    return asked.groupBy("part").applyInArrow(find, "doc_id long, nth long, shard int, offset long, n long")


def read_store(spark: SparkSession, path: str, keys: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Keyed reads: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids`` as little-endian unsigned 32-bit integers)."""
    shards = spark.read.parquet(f"{path}/manifest.parquet").select("shard", "file", "base")
    at = lookup(spark, path, keys).join(shards, "shard")
    at = at.repartition("shard").sortWithinPartitions("shard", "offset")

    def run(batches):
        fs, root = filesystem(path)
        name, f, width = None, None, 0
        for batch in batches:
            rows = []
            for file, doc_id, base, offset, n in zip(*(batch[c].to_pylist() for c in ("file", "doc_id", "base", "offset", "n")), strict=True):
                if file != name:
                    name, f = file, fs.open_input_file(f"{root}/{file}")
                    head = f.read(HEADER)
                    if head[:8] != MAGIC:
                        raise ValueError(f"{file} is no id shard")
                    width = int.from_bytes(head[8:], "little")
                if f.tell() != HEADER + offset * width:
                    f.seek(HEADER + offset * width)
                ids = np.frombuffer(f.read(n * width), f"<u{width}").astype("<u4").tobytes()
                rows.append((doc_id, base + offset, len(ids) // 4, zlib.crc32(ids), ids))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [*[pa.int64()] * 4, pa.binary()][: 4 + keep_ids]
            names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names)

    at = at.select("file", "doc_id", "base", "offset", "n")
    return at.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def all_keys(docs: DataFrame) -> DataFrame:
    """The keys of ``docs``: each ``doc_id`` with the number of the occurrence.

    Occurrences are counted, then spelled out in runs of ``RUN``, so that a frequent ``doc_id`` is no task's work.
    """
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("times"))
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / RUN)))
    run = counts.select("doc_id", "times", runs.alias("run"))
    nth = F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("times"), (F.col("run") + 1) * RUN) - 1))
    return run.repartition("doc_id", "run").select("doc_id", nth.alias("nth"))
