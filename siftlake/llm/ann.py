"""Maximum inner product search with score-aware (anisotropic) quantisation.

Vectors are quantised by 4-bit codes of small subspaces. Codebooks and codes minimise a loss that weighs the part of the
residual parallel to the vector ``eta`` times as much as the rest, since that part moves large inner products. A query
builds tables of its products with the codewords; blocks of codes are scanned through these tables. Each vector keeps a
bound of its quantisation error, so a table score tells the best exact score its vector can have: the best ``PROBE`` of a
block give a first exact score to beat, and every vector that can still reach it is scored exactly in double precision on
the original vectors, however many those are. Every block is scanned for every query, in pairs of bounded blocks; nothing
is capped and the neighbours are the exact ones.

Equal vectors are one class with its ``k + 1`` smallest ids, so that a vector held by a third of the rows costs one entry.

Codebooks are fitted on a sample of at most ``SAMPLE`` distinct vectors, those of the smallest hashes of their ids.

Defined results: vectors that are null, empty, zero, of another length than most, or with null or non-finite components
take no part; equal scores go to the smaller id; fewer candidates than ``k`` are all returned; of rows that share an id
only the vector of the smallest hash takes part; an empty table gives no rows; other columns are ignored. Long vectors
make smaller blocks (``BLOCK_BYTES``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.llm.common import materialize

SAMPLE = 8192
ROUNDS = 4
CODEWORDS = 16
#: Vectors and queries that meet in one task, at most, and bytes of either. Every vector is shipped once for each block
#: of queries and every query once for each block of vectors, so that blocks of equal size ship least.
VECTORS, QUERIES, BLOCK_BYTES = 8192, 8192, 16 << 20
#: Vectors of each block that are scored exactly first, for the score that the others have to reach.
PROBE = 100
#: Inner products of at least this share of the vector's norm are those that matter.
SHARE = 0.2


class Codebook:
    """4-bit codewords of subspaces, fitted and applied under the anisotropic loss."""

    def __init__(self, words: np.ndarray, eta: float):
        self.words, self.eta = words, eta  # subspaces x 16 x width

    @staticmethod
    def split(x: np.ndarray, width: int = 2) -> np.ndarray:
        n, d = x.shape
        pad = -d % (2 * width)
        return np.pad(x, ((0, 0), (0, pad))).reshape(n, -1, width)

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = ROUNDS) -> Codebook:
        d = x.shape[1]
        eta = max(1.0, (d - 1) * SHARE**2 / (1 - SHARE**2))
        parts = cls.split(x)
        rng = np.random.default_rng(7)
        first = parts[rng.integers(0, len(x), CODEWORDS)].transpose(1, 0, 2).copy()
        book = cls(first, eta)
        for _ in range(rounds):  # plain codewords to start from
            book._update(parts, book._nearest(parts), 1.0)
        for _ in range(rounds):
            book._update(parts, book.encode(x), eta)
        return book

    def _nearest(self, parts: np.ndarray) -> np.ndarray:
        codes = [((p[:, None, :] - w[None]) ** 2).sum(2).argmin(1) for p, w in zip(parts.transpose(1, 0, 2), self.words, strict=True)]
        return np.stack(codes, 1).astype(np.uint8)

    def _update(self, parts: np.ndarray, codes: np.ndarray, eta: float) -> None:
        """The best codewords of each subspace in turn for given codes."""
        norm = np.maximum((parts**2).sum((1, 2)), 1e-30)
        pull = (eta - 1) / norm
        s_index = np.arange(parts.shape[1])
        along = ((parts - self.words[s_index, codes]) * parts).sum(2)  # of each subspace, parallel to the vector
        total = along.sum(1)
        width = parts.shape[2]
        for s in s_index:
            p, c = parts[:, s], codes[:, s]
            others = total - along[:, s]
            sums = lambda w: np.bincount(c, w, CODEWORDS)
            held = np.bincount(c, minlength=CODEWORDS)
            a = np.array([[sums(pull * p[:, i] * p[:, j]) + held * (i == j) for j in range(width)] for i in range(width)]).transpose(2, 0, 1)
            scale = 1 + pull * (others + (p**2).sum(1))
            b = np.array([sums(scale * p[:, i]) for i in range(width)]).T
            used = held > 0
            self.words[s, used] = np.linalg.solve(a[used], b[used][..., None])[..., 0]
            new = ((p - self.words[s, c]) * p).sum(1)
            total += new - along[:, s]
            along[:, s] = new

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of each vector: coordinate descent over the subspaces, from the nearest codewords."""
        parts = self.split(x)
        codes = self._nearest(parts)
        pull = (self.eta - 1) / np.maximum((parts**2).sum((1, 2)), 1e-30)
        s_index = np.arange(parts.shape[1])
        total = ((parts - self.words[s_index, codes]) * parts).sum((1, 2))
        for _ in range(sweeps):
            for s in s_index:
                p = parts[:, s]
                residual = p[:, None, :] - self.words[s][None]
                along = (residual * p[:, None, :]).sum(2)
                rows = np.arange(len(p))
                others = total - along[rows, codes[:, s]]
                loss = (residual**2).sum(2) + pull[:, None] * (others[:, None] + along) ** 2
                codes[:, s] = loss.argmin(1)
                total = others + along[rows, codes[:, s]]
        return codes

    def packed(self, x: np.ndarray) -> np.ndarray:
        codes = self.encode(x)
        return codes[:, ::2] | (codes[:, 1::2] << 4)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query with both codewords of a byte: queries x bytes x 256."""
        products = np.einsum("qsw,scw->qsc", self.split(queries), self.words).astype(np.float32)
        low, high = products[:, ::2], products[:, 1::2]
        return (high[..., :, None] + low[..., None, :]).reshape(len(queries), -1, CODEWORDS * CODEWORDS)


def error_bounds(book: Codebook, vectors: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each vector ``e``: a query of norm 1 has a table score within ``e`` of the exact one."""
    words = np.stack([codes & 15, codes >> 4], 2).reshape(len(codes), -1)
    parts = book.split(vectors)
    coded = book.words[np.arange(parts.shape[1]), words]
    norm = lambda x: np.sqrt((x**2).sum((1, 2)))
    # Table scores are sums of as many single-precision numbers as a code has bytes.
    rounding = (codes.shape[1] + 4) * 2.0**-23
    return norm(parts - coded) * (1 + 1e-9) + rounding * norm(coded)


def scan_block(book: Codebook, vectors: np.ndarray, codes: np.ndarray, errors: np.ndarray, queries: np.ndarray, keep: int):
    """For each query the places of the ``keep`` best vectors of the block and their exact scores; ties by place."""
    m = len(vectors)
    keep = min(keep, m)
    probe = min(m, max(PROBE, keep))
    norms = np.sqrt((vectors**2).sum(1))
    places = codes.T.astype(np.intp)
    for x in range(0, len(queries), 64):
        q = queries[x : x + 64]
        tables = book.tables(q)
        score = np.zeros((len(q), m), np.float32)
        with np.errstate(invalid="ignore", over="ignore"):
            for b, place in enumerate(places):
                score += tables[:, b].take(place, axis=1)
        first = np.argpartition(-score, probe - 1, axis=1)[:, :probe]
        to_beat = -np.partition(-np.einsum("qrd,qd->qr", vectors[first], q), keep - 1, axis=1)[:, keep - 1]
        length = np.sqrt((q**2).sum(1))
        slack = length[:, None] * errors + 1e-30  # numbers below single precision count as zero in tables
        reach = ~(score + slack < to_beat[:, None]) | ~np.isfinite(score)
        some = np.flatnonzero(reach.any(axis=0))
        # The products of a matrix may round apart from those kept: what is within that of the last kept one stays.
        rough = q @ vectors[some].T
        margin = 1e-12 * length * norms[some].max()
        last = -np.partition(-rough, keep - 1, axis=1)[:, keep - 1] - margin
        at, best = np.empty((len(q), keep), np.int64), np.empty((len(q), keep))
        for k in range(len(q)):
            near = some[~(rough[k] < last[k])]
            exact = np.einsum("rd,d->r", vectors[near], q[k])
            order = np.argsort(-exact, kind="stable")[:keep]
            at[k], best[k] = near[order], exact[order]
        yield at, best


def matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(v: Column) -> Column:
    """Whether a vector holds only finite numbers and is not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def one_for_each_id(own: DataFrame) -> DataFrame:
    """The rows without those whose id has another vector of a smaller hash. Only hashes are shuffled to find them."""
    hashed = own.withColumn("h", F.xxhash64("v"))
    several = hashed.groupBy("vec_id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least < most")
    several = materialize(several.select(F.col("vec_id").alias("several"), "least"), "ann-several")
    other = (F.col("vec_id") == F.col("several")) & (F.col("h") > F.col("least"))
    return hashed.join(several, other, "left_anti").drop("h")


def search(table: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of the rows for which ``queries`` holds."""
    spark = table.sparkSession
    own = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("asks"))
    own = own.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    widths = own.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").head(1)
    schema = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], schema)
    width = widths[0].width
    own = one_for_each_id(own.where(F.size("v") == width))
    block_rows = lambda most: max(1, min(most, BLOCK_BYTES // (8 * width)))

    least = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    few = own.select("v", "vec_id").distinct().withColumn("nth", least).where(F.col("nth") <= k + 1)
    classes = few.groupBy("v").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = materialize(classes, "ann-classes")
    n = classes.count()
    sample = classes.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow()  # at most SAMPLE rows
    book = spark.sparkContext.broadcast(Codebook.fit(matrix(sample["v"], width)))
    blocks = max(1, -(-n // block_rows(VECTORS)))

    def quantise(batches):
        for batch in batches:
            codes = book.value.packed(matrix(batch["v"], width))
            errors = error_bounds(book.value, matrix(batch["v"], width), codes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)], [*batch.schema.names, "code", "error"]
            )

    coded = classes.select("rep", "v", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"))
    coded = materialize(coded.mapInArrow(quantise, "rep long, v array<double>, block int, code binary, error double"), "ann-codes")

    asks = materialize(own.where("asks").select("vec_id", "v").distinct().join(classes.select("v", "rep"), "v").select("vec_id", "rep"), "ann-asks")
    distinct = asks.select("rep").distinct().join(classes.select("rep", "v"), "rep")
    chunks = max(1, -(-asks.count() // block_rows(QUERIES)))
    distinct = distinct.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "rep"), F.lit(chunks)).cast("int"))
    left = coded.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = distinct.select(F.col("rep").alias("q"), "v", "chunk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def scan(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"q": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)}
        if len(vectors) and len(asked):
            vectors = vectors.sort_by("rep")  # equal scores go to the smaller id
            x, reps = matrix(vectors["v"], width), vectors["rep"].to_numpy()
            codes = np.frombuffer(b"".join(vectors["code"].to_pylist()), np.uint8).reshape(len(x), -1)
            found = list(scan_block(book.value, x, codes, vectors["error"].to_numpy(), matrix(asked["v"], width), k + 1))
            at, score = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            out = {"q": np.repeat(asked["q"].to_numpy(), at.shape[1]), "rep": reps[at.ravel()], "score": score.ravel()}
        return pa.table(out)

    near = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(scan, "q long, rep long, score double")
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "rep"))
    near = near.withColumn("place", place).where(F.col("place") <= k + 1).join(classes.select("rep", "ids"), "rep")
    hit = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("vec_id")))
    near = near.select("q", hit.alias("hits")).groupBy("q").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    others = F.filter("hits", lambda h: h["vec_id"] != F.col("query_id"))
    best = F.slice(F.array_sort(others), 1, k)
    rows = asks.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("q")).join(near, "q")
    rows = rows.select("query_id", F.posexplode(best).alias("place", "hit"))
    return rows.select("query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.s")).alias("score"))
