"""Shared plumbing of the training-data operators: the shared folder, written tables, scoped settings."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from siftlake.llm.tokens import forget_encoders
from siftlake.scratch import shared_path

#: A side this small (``memory_bytes``) may be broadcast; larger ones are shuffled.
BROADCAST_BYTES = 8 << 20
#: Shuffled bytes (compressed) that one task of a written table reads.
SHUFFLE_BYTES = "32m"
#: On local disks: no checksum files, each of which costs further processes that set permissions.
LOCAL_DISK = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: Rows of an Arrow batch and bytes of text that a Python worker looks at together.
BATCH_ROWS, PIECE_BYTES = 1000, 1 << 20
#: A writer holds a whole row group in memory, and readers split files at row groups.
ROW_GROUP_BYTES = 16 << 20

_written: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder (``spark.checkpoint.dir``); removed when the driver process ends."""
    path = shared_path(spark, name)
    _written.append(path)
    return path


def remove(path: str) -> None:
    """Delete a folder of the shared folder, if it is still there."""
    with contextlib.suppress(Exception):
        fs, p = filesystem(path)
        fs.delete_dir(p)
    if path in _written:
        _written.remove(path)


@atexit.register
def _remove_scratch() -> None:
    for path in [*_written]:
        remove(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and inner path of a URI or an absolute path, on the driver or an executor."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


def write_table(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    conf = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
        # Few files of a decent size (Spark's default) instead of many small ones: each costs a task, and on local disks a
        # process for its permissions.
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": SHUFFLE_BYTES,
    }
    options = {"compression": "zstd", "parquet.block.size": str(ROW_GROUP_BYTES)} | (LOCAL_DISK if path.startswith("file:") else {})
    with settings(df.sparkSession, conf):
        df.write.options(**options).parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``write_table`` for a table that stays until the driver process ends."""
    return write_table(df, name)[1]


class Tables:
    """The written tables of one run of an operator by name, so that those no longer read can go before its end."""

    def __init__(self, prefix: str):
        self.prefix, self.paths = prefix, {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name], out = write_table(df, f"{self.prefix}-{name}".replace(" ", "-"))
        return out

    def drop(self, *names: str) -> None:
        """Remove tables that neither a lazy result nor a later step reads."""
        for name in names:
            remove(self.paths.pop(name))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut where their texts pass ``most`` bytes, so that memory does not follow the lengths of texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
        at = size = 0
        for k, n in enumerate(sizes):
            size += n
            if size >= most:
                yield batch.slice(at, k + 1 - at)
                at, size = k + 1, 0
        if at < len(sizes):
            yield batch.slice(at)


def tidy(run: Callable, encodes: bool = False) -> Callable:
    """``run`` for ``mapInArrow``, in workers that hold no more than they use.

    Spark gives a worker to task after task, of any operator. Kept chunks of tokenizers go when a task starts that does not
    encode, and when a task ends, memory that is free goes back to the system, which malloc and Arrow would keep.
    """

    @functools.wraps(run)
    def tidied(batches):
        if not encodes:
            forget_encoders()
        yield from run(batches)
        release_memory()

    return tidied


def release_memory() -> None:
    """Give what this process has freed back to the system; nothing on systems whose C library cannot."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def by_shuffle(df: DataFrame) -> DataFrame:
    """A join side that grows with the input: never broadcast, so that the plan is the same at every size."""
    return df.hint("shuffle_merge")


def memory_bytes(df: DataFrame) -> int:
    """A bound of what the rows of ``df`` take in memory: 32 bytes for each, 16 for each value, and the bytes of strings."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))]
    size = F.lit(32 + 16 * len(df.columns)).cast("long")
    for name in texts:
        size = size + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
    return df.agg(F.sum(size)).first()[0] or 0


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for the eager part of an operator."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and give it to ``body``, whatever the optimiser does with projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """``(node, component)`` of an undirected edge table of longs, component = smallest node.

    Alternating large-star and small-star rounds on written tables until the labels have settled: O(log^2 n) rounds, edges
    never leave the executors, and a node with many neighbours is reduced by a partially combined ``min`` and a join that
    AQE may split. Tables of earlier rounds are removed. The result reads one written table.
    """
    at, e = write_table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), f"{name}-e")
    while True:  # until the labels have settled
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at_large, e2 = write_table(large.where("u <> v").distinct(), f"{name}-l")
        low = e2.groupBy("u").agg(F.min("v").alias("m"))
        small = e2.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        remove(at)
        at, e = write_table(small.where("u <> v").distinct(), f"{name}-s")
        remove(at_large)
        # Settled: every node has one edge, to a node that has none, which a further round would leave as it is.
        now = e.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        if now.n == now.d and not e.join(e.select(F.col("v").alias("u")), "u", "left_semi").head(1):
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
