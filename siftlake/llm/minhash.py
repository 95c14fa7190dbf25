"""Near-duplicate detection with DartMinHash signatures and banded joins.

A document is the multiset of its shingles of ``SHINGLE`` words (lower case, punctuation apart). Darts are thrown by
hashing: each cell of one unit of a shingle's weight and one unit of rank holds a Poisson number of darts with a rank and
a coordinate; the earliest dart of every coordinate is the signature, in O(k log k + words) whatever the weights. Equal
word sequences are put together first. Documents that share a band (a bucket) meet a central
document of it; pairs are verified by their exact weighted Jaccard similarity; connected components are the classes.
Buckets whose documents ended in more than one component then have every pair with a document outside their largest one
compared, large buckets in blocks that emit links only, so that no link of a shared band is lost.

Defined results: a null text, or one without words, is alone in its class; fewer than ``SHINGLE`` words are one shingle;
documents without ``doc_id`` are left out of classes by ``classes`` and kept by ``keep_one``; rows that share a ``doc_id``
are in one class, and each of their texts is compared by itself; an empty table gives no rows; other columns are ignored,
or carried by ``keep_one``. Long texts are read by pieces: a worker holds about 12 bytes for each byte of the longest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import Tables, by_shuffle, connected_components, materialize, pieces, tidy
from siftlake.llm.wordhash import MULTIPLIERS, PUNCTUATION, RangeHash, U, Words, mix, pieces_of, range_hash, slices

SHINGLE = 5
THRESHOLD = 0.8
#: 30 bands of 5: a pair of similarity 0.8 shares none with probability 7e-6.
BANDS, ROWS = 30, 5
COORDINATES = BANDS * ROWS
SLICE_BYTES = 1 << 18
#: Cells that are thrown together.
CELLS = 1 << 16
#: Buckets of up to so many texts are compared by a join of pairs, larger ones within tasks in blocks of at most about
#: ``BLOCK`` texts and ``BLOCK_SHINGLES`` shingles (a longer text is a block of its own).
SMALL_BUCKET, BLOCK, BLOCK_SHINGLES = 16, 256, 1 << 18
RANK_BITS = 40


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ``doc, shingle, times`` of all texts of ``words``."""
    count = np.diff(words.first)
    n = np.where(count == 0, 0, np.maximum(1, count - SHINGLE + 1))
    doc = np.repeat(np.arange(len(count)), n)
    start = words.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    hashes = RangeHash(words.hashes)(start, np.minimum(start + SHINGLE, words.first[doc + 1]))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])) if len(doc) else np.zeros(0, int)
    return doc[new], hashes[new], np.diff(np.append(new, len(doc)))


def gather(texts: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """``doc, shingle, times`` (by text) of texts, their numbers of words, and two hashes of all words of each.

    Texts of more than ``2 * most`` bytes are read by pieces that overlap by a shingle.
    """
    long_ = [k for k, t in enumerate(texts) if len(t) > 2 * most]
    words = Words([b"" if len(t) > 2 * most else t for t in texts], PUNCTUATION)
    count = np.diff(words.first)
    whole = [RangeHash(words.hashes, k)(words.first[:-1], words.first[1:]) for k in (0, 1)]
    parts = [shingles(words)]
    for k in long_:
        element, times, count[k], hashes = long_shingles(texts[k], most)
        parts.append((np.full(len(element), k), element, times))
        for column, h in zip(whole, hashes, strict=True):
            column[k] = h
    doc, element, times = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(doc, kind="stable") if long_ else slice(None)
    return doc[order], element[order], times[order], count, whole


def long_shingles(text: bytes, most: int) -> tuple[np.ndarray, np.ndarray, int, list[np.uint64]]:
    """Sorted shingles, their times, the number of words and two hashes of all words of a single text, by pieces."""
    found, base, sums = [], 0, [0, 0]
    for piece, behind in pieces_of(text, most, SHINGLE - 1, PUNCTUATION):
        words = Words([piece + behind], PUNCTUATION)
        own = int(np.searchsorted(words.start, len(piece)))
        at = np.arange(min(own, max(0, len(words.hashes) - SHINGLE + 1)))
        found.append(RangeHash(words.hashes)(at, at + SHINGLE))
        for k, m in enumerate(MULTIPLIERS):
            sums[k] += int(RangeHash(words.hashes, k).sums[own]) * pow(m, base, 1 << 64)
        base += own
    if base < SHINGLE:
        words = Words([text], PUNCTUATION)
        found = [RangeHash(words.hashes)(np.array([0]), np.array([base]))] if base else []
    element, times = np.unique(np.concatenate([np.zeros(0, U), *found]), return_counts=True)
    return element, times, base, [range_hash(np.array([x % (1 << 64)], U), np.array([base]))[0] for x in sums]


#: Chances, as unsigned 64-bit thresholds, that a Poisson number of mean 1 is at most 0, 1, 2, ...
POISSON = np.array([min(2**64 - 1, int(sum(math.exp(-1) / math.factorial(i) for i in range(m + 1)) * 2.0**64)) for m in range(16)], U)


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int = COORDINATES) -> np.ndarray:
    """``docs`` rows of ``k``: the earliest dart of each coordinate; rows of documents without elements stay at the maximum."""
    best = np.full(docs * k, np.iinfo(U).max, U)
    total = np.bincount(doc, weight, docs)
    reach = np.where(total > 0, (k * math.log(k) + 3 * k) / np.maximum(total, 1), 0)
    open_ = total > 0
    while open_.any():
        use = open_[doc]
        d, e, w = doc[use], element[use], weight[use].astype(np.int64)
        ranks = np.ceil(reach[d]).astype(np.int64)
        for x, y in slices((w * ranks).tolist(), CELLS):
            _throw(best, d[x:y], e[x:y], w[x:y], ranks[x:y], reach, k)
        open_ = (best.reshape(docs, k) == np.iinfo(U).max).any(axis=1) & open_
        reach = reach * 2  # the same darts and later ones, until every coordinate has one
    return best.reshape(docs, k)


def _throw(best, d, e, w, ranks, reach, k) -> None:
    cells = w * ranks
    which = np.repeat(np.arange(len(d)), cells)
    number = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    unit, rank = np.divmod(number, ranks[which])
    with np.errstate(over="ignore"):
        cell = mix(e[which] ^ (unit.astype(U) * U(0x9E3779B97F4A7C15) + rank.astype(U) * U(0xC6A4A7935BD1E995)))
    darts = np.searchsorted(POISSON, cell, side="right")
    dart = np.repeat(np.arange(len(cell)), darts)
    nth = np.arange(len(dart)) - np.repeat(np.cumsum(darts) - darts, darts)
    with np.errstate(over="ignore"):
        h = mix(cell[dart] + (nth.astype(U) + U(1)) * U(0xA24BAED4963EE407))
        coordinate = ((h >> U(RANK_BITS)) * U(k)) >> U(64 - RANK_BITS)
    at = (rank[dart].astype(U) << U(RANK_BITS)) | (h & U((1 << RANK_BITS) - 1))
    owner = d[which[dart]]
    near = at < (reach[owner] * 2.0**RANK_BITS).astype(U)
    np.minimum.at(best, (owner * k + coordinate.astype(np.int64))[near], at[near])


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """``BANDS`` hashes for each signature."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    out = np.tile(mix(np.arange(BANDS, dtype=U) + U(1)), (len(signatures), 1))
    for r in range(ROWS):
        with np.errstate(over="ignore"):
            out = mix(out * U(0x9DDFEA08EB382D69) + parts[:, :, r])
    return out


def normalized(texts: list[str | None]) -> list[bytes]:
    return [(t or "").lower().encode() for t in texts]


def sign(docs: DataFrame) -> DataFrame:
    """``doc_id, q1, q2, size, bands`` of every document (``size`` in shingles); ``bands`` is null where there are no words."""

    most = SLICE_BYTES  # travels with the function

    def run(batches):
        for batch in pieces(batches):
            texts = normalized(batch["text"].to_pylist())
            for x, y in slices([len(t) for t in texts], most):
                doc, element, times, count, whole = gather(texts[x:y], most)
                keys = band_keys(dart_signatures(doc, element, times, y - x))
                size = np.bincount(doc, times, y - x).astype(np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, BANDS * (y - x + 1), BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()),
                    mask=pa.array(count == 0),
                )
                cols = [w.view(np.int64) for w in whole]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][x:y], *map(pa.array, [*cols, size]), lists], ["doc_id", "q1", "q2", "size", "bands"])

    docs = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull())
    return docs.mapInArrow(tidy(run), "doc_id long, q1 long, q2 long, size long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, q1, q2, shingles``: sorted 32-bit hashes of (shingle, occurrence), so that plain sets compare the multisets."""

    most = SLICE_BYTES

    def run(batches):
        for batch in pieces(batches):
            texts, ids = normalized(batch["text"].to_pylist()), batch["doc_id"]
            for x, y in slices([len(t) for t in texts], most):
                doc, element, times, _, whole = gather(texts[x:y], most)
                which = np.repeat(np.arange(len(doc)), times)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                with np.errstate(over="ignore"):
                    value = (mix(element[which] + nth.astype(U) * U(0x9E6C63D0876A9A47)) >> U(32)).astype(np.uint32)
                at = np.searchsorted(doc[which], np.arange(y - x + 1))
                sets = [np.sort(value[at[k] : at[k + 1]]).tobytes() for k in range(y - x)]
                cols = [pa.array(w.view(np.int64)) for w in whole]
                yield pa.RecordBatch.from_arrays([ids[x:y], *cols, pa.array(sets, pa.binary())], ["doc_id", "q1", "q2", "shingles"])

    return docs.mapInArrow(tidy(run), "doc_id long, q1 long, q2 long, shingles binary")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those ``pairs`` of texts (``a, b``) whose sets have a Jaccard similarity of ``threshold`` or more, as documents."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sa = sets.select(F.col("t").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("t").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(sa, "a").join(sb, "b").select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), "sa", "sb")
    return both.mapInArrow(run, "a long, b long")


def bucket_links(outside: pa.Table, everyone: pa.Table, threshold: float) -> pa.Table:
    """Links of one bucket's block: pairs of different components, only those that join what is not joined yet."""
    links: list[tuple[int, int]] = []
    if len(outside) and len(everyone):
        sets = [np.frombuffer(x, np.uint32) for x in everyone["shingles_"].to_pylist()]
        size = np.array([len(x) for x in sets])
        universe, ids = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(size) - size
        reps, component = everyone["rep_"].to_numpy(), everyone["component_"].to_numpy().copy()
        xs = zip(outside["rep"].to_pylist(), outside["component"].to_pylist(), outside["shingles"].to_pylist(), strict=True)
        joined: dict[int, int] = {}
        for rep, own, raw in xs:
            while own in joined:
                own = joined[own]
            x = np.frombuffer(raw, np.uint32)
            at = np.minimum(np.searchsorted(universe, x), len(universe) - 1)
            held = np.zeros(len(universe), np.int32)
            held[at[universe[at] == x]] = 1
            both = np.add.reduceat(held[ids], starts)
            near = np.flatnonzero(both >= threshold * (len(x) + size - both) - 1e-9)
            for k in near[component[near] != own]:
                if component[k] != own:
                    links.append((rep, int(reps[k])))
                    joined[int(component[k])] = own
                    component[component == component[k]] = own
    return pa.table({"a": pa.array([min(x) for x in links], pa.int64()), "b": pa.array([max(x) for x in links], pa.int64())})


def classes(docs: DataFrame, threshold: float = THRESHOLD, t: Tables | None = None) -> DataFrame:
    """``doc_id, class_id`` of every document; ``class_id`` is the smallest ``doc_id`` of its class.

    Of the tables ``t`` the result reads ``signed`` and ``texts``.
    """
    t = t or Tables("minhash")
    signed = t(sign(docs), "signed")
    first = [F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands")]
    texts = t(signed.where(F.col("bands").isNotNull()).groupBy("q1", "q2").agg(*first), "texts")
    # A text is known by its smallest document and its hashes: a document may have several texts.
    bands = texts.select(F.struct("rep", "q1", "q2").alias("t"), "size", F.posexplode("bands").alias("band", "key"))
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = t(bands.join(by_shuffle(t(shared, "shared")), ["band", "key"]), "members")

    # The pivot of a bucket is its document with the most band partners overall: the centre of a group of copies, to
    # which the others are nearer than to each other.
    degree = members.groupBy("t").agg(F.sum("n").alias("degree"))
    ranked = members.join(degree, "t")
    pivots = ranked.groupBy("band", "key").agg(F.max(F.struct("degree", (-F.col("t.rep")).alias("minus"), "t")).alias("top"))
    # Written, so that the join below is dealt by an exchange of its own, which AQE may split at a hot bucket.
    pivots = t(pivots.select("band", "key", F.col("top.t").alias("pivot")), "pivots")
    pairs = members.join(pivots, ["band", "key"]).where("t <> pivot")
    pairs = t(pairs.select(F.least("t", "pivot").alias("a"), F.greatest("t", "pivot").alias("b")).distinct(), "pairs")

    ids = t(members.select(F.col("t.rep").alias("doc_id")).distinct(), "ids")
    rows = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull())
    text = ["doc_id", "q1", "q2"]
    sets = shingle_sets(rows.join(ids, "doc_id", "left_semi")).dropDuplicates(text)
    sets = t(sets.select(F.struct(F.col("doc_id").alias("rep"), "q1", "q2").alias("t"), "shingles"), "sets")
    t.drop("shared", "pivots", "ids")

    # Documents of several texts join the classes of all of them.
    both = F.struct("q1", "q2")
    several = signed.groupBy("doc_id").agg(F.min(both).alias("x"), F.max(both).alias("y")).where("x <> y").select("doc_id")
    several = t(several, "several")
    same = signed.select(*text).join(several, "doc_id", "left_semi").join(texts.select("q1", "q2", "rep"), ["q1", "q2"])
    same = same.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = t(verify(pairs, sets, threshold).union(same), "links")
    component = t(connected_components(links), "components")

    # Buckets with several components: every pair of a document outside the largest with one of another component.
    where = component.select(F.col("node").alias("rep"), "component")
    at = members.withColumn("rep", F.col("t.rep")).join(where, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = at.groupBy("band", "key", "component").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("size"))
    mixed = sizes.groupBy("band", "key").agg(
        F.count("*").alias("m"), F.sum("n").alias("all"), F.max("n").alias("most"), F.sum("size").alias("all_size"),
        F.max_by("component", F.struct("n", "component")).alias("largest"),
    ).where("m > 1 AND all > 2")
    # Blocks hold so many texts and shingles; those outside the largest component are dealt into blocks of their own.
    cuts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    outside_of = F.col("all") - F.col("most")
    mixed = mixed.select(
        "band", "key", "all", "largest", cuts(F.col("all"), F.col("all_size")).alias("ys"),
        cuts(outside_of, F.col("all_size") * outside_of / F.col("all")).alias("xs"),
    )
    at = t(at.drop("n").join(t(mixed, "mixed"), ["band", "key"]), "placed")
    t.drop("members", "mixed")
    outside = lambda df: df.where("component <> largest")

    few = at.where(F.col("all") <= SMALL_BUCKET)
    x = outside(few).select("band", "key", F.col("t").alias("x"), F.col("component").alias("cx"))
    y = few.select("band", "key", F.col("t").alias("y"), F.col("component").alias("cy"))
    more = x.join(y, ["band", "key"]).where("cx <> cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    more = t(more.distinct().join(pairs, ["a", "b"], "left_anti"), "more")

    # Larger ones are compared in blocks within tasks; only links leave them.
    many = at.where(F.col("all") > SMALL_BUCKET).join(sets, "t")
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "t"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = ["band", "key", "xb", "yb"]
    left = outside(many).withColumn("xb", deal("x", "xs")).withColumn("yb", others("ys")).select(*block, "rep", "component", "shingles")
    right = many.withColumn("yb", deal("y", "ys")).withColumn("xb", others("xs")).select(*block, "rep", "component", "shingles")
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])  # apart from the left side's columns
    blocked = left.groupBy(*block).cogroup(right.groupBy(*[f"{c}_" for c in block])).applyInArrow(
        lambda a, b: bucket_links(a, b, threshold), "a long, b long"
    )
    links = links.union(verify(more, sets, threshold)).union(blocked)
    component = connected_components(links, name="cc2").select(F.col("node").alias("rep"), F.col("component").alias("class"))
    t.drop("pairs", "sets", "several", "links", "components", "placed", "more")  # the result reads the signed texts and classes

    alone = signed.where(F.col("bands").isNull()).select("doc_id").join(component.withColumnRenamed("rep", "doc_id"), "doc_id", "left")
    alone = alone.select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))
    texts = texts.select("q1", "q2", "rep").join(component, "rep", "left")
    out = signed.where(F.col("bands").isNotNull()).select(*text).join(texts, ["q1", "q2"])
    return out.select("doc_id", F.coalesce("class", "rep").alias("class_id")).union(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one of each class, that of the smallest ``doc_id``; rows of equal ``doc_id`` stay together."""
    t = Tables("minhash")
    found = classes(docs, threshold, t)
    drop = materialize(found.where("doc_id <> class_id").select(F.col("doc_id").alias("__drop")).distinct(), "minhash-drop")
    t.drop("signed", "texts")
    return docs.join(drop, F.col("doc_id").cast("long") == F.col("__drop"), "left_anti")
