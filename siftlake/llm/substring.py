"""Substring deduplication by recompression.

Texts are parsed by rounds that name runs of equal symbols, then pairs of a left and a right symbol. Names are hashes of
what they stand for, so they are the same everywhere without a dictionary (see the README for what a dictionary would
cost). Each symbol carries the range of words that alone decides that it is formed (its context), so that every occurrence
of a window that holds the context has the symbol, too. Every window of ``WINDOW`` words picks one symbol of the highest
level that it holds (the least name; a single word in the last resort), and one row goes out for each symbol and the
windows it stands for, about one in twenty words. Symbols that occur in one document only are dropped. For shared ones,
whole stretches (all windows of a symbol) are verified by digests of their words: equal ones are settled by their smallest
document. Windows one by one are only compared, again by digests of their words, for the first document of each
differing stretch.

Digests are 128 bits of BLAKE2b over the words themselves (64 of them beside a 64-bit range hash for single windows);
names only bring candidates together.

Long texts are read in pieces of ``SLICE_BYTES`` that overlap by a window. A window's symbol depends on the window alone,
so pieces change nothing but where stretches end. A worker holds about 5 bytes for each byte of the longest text.

Defined results: a null text has no words; documents without ``doc_id`` neither remove nor lose words; rows that share a
``doc_id`` never remove each other's words; documents of fewer than ``WINDOW`` words are left alone; an empty table gives
no rows; other columns are ignored, or carried by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import Tables, by_shuffle, pieces, tidy
from siftlake.llm.wordhash import RangeHash, U, Words, mix, pieces_of

WINDOW = 50
ROUNDS = 4
SLICE_BYTES = 1 << 18
FAR = 1 << 40
#: Low bits of a name that give way to its place, so that the leftmost of equal names wins, alike in all pieces.
PLACE_BITS = U(28)


def parse(hashes: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The contexts of the symbols of each level, from words up: ranges of words (beyond ``FAR`` where a text's end decides)."""
    name, lo = hashes, np.arange(len(hashes), dtype=np.int64)
    hi = lo + 1
    levels = [(lo, hi)]

    def neighbours(name, lo, hi, doc):
        """Contexts of the symbols before and after each; of none: far away."""
        same = doc[1:] == doc[:-1]
        before = np.full(len(name), -FAR)
        before[1:][same] = lo[:-1][same]
        after = np.full(len(name), FAR)
        after[:-1][same] = hi[1:][same]
        return before, after, same

    for r in range(rounds):
        if len(name) < 2:
            break
        before, after, same = neighbours(name, lo, hi, doc)
        first = np.concatenate([[True], ~(same & (name[1:] == name[:-1]))])
        at = np.flatnonzero(first)
        last = np.concatenate([at[1:], [len(name)]]) - 1
        times = (last - at + 1).astype(U)
        with np.errstate(over="ignore"):
            name = np.where(times > 1, mix(name[at] + times * U(0xC2B2AE3D27D4EB4F)), name[at])
        lo, hi, doc = np.minimum(before[at], lo[at]), np.maximum(after[last], hi[last]), doc[at]

        before, after, same = neighbours(name, lo, hi, doc)
        left = (mix(name ^ U(r + 1)) & U(1)) == 0
        joins = np.zeros(len(name), bool)
        joins[:-1] = left[:-1] & ~left[1:] & same
        joined = np.concatenate([[False], joins[:-1]])
        with np.errstate(over="ignore"):
            pair = mix(name[:-1] * U(0x9E3779B185EBCA87) + name[1:])
        new = name.copy()
        new[:-1][joins[:-1]] = pair[joins[:-1]]
        nlo = np.where(left, lo, np.minimum(lo, before))
        nhi = np.where(left, np.maximum(hi, after), hi)
        name, lo, hi, doc = new[~joined], nlo[~joined], nhi[~joined], doc[~joined]
        levels.append((lo, hi))
    return levels


def choose(words: Words, window: int = WINDOW) -> dict[str, np.ndarray]:
    """For every window of every text its symbol: rows ``doc, key, i0, i1`` (first and last window) and the words' digest ``s1, s2``."""
    n = len(words.hashes)
    count = np.diff(words.first)
    doc = np.repeat(np.arange(len(count)), count)
    # Windows that stay within their text.
    i = np.arange(max(0, n - window + 1))
    i = i[doc[i] == doc[i + window - 1]] if len(i) else i
    chosen, start = np.zeros(len(i), U), np.zeros(len(i), np.int64)
    open_ = np.arange(len(i))
    hashes = RangeHash(words.hashes)
    for lo, hi in reversed(parse(words.hashes, doc)):
        if not len(open_):
            break
        fits = (lo >= 0) & (hi <= n) & (hi - lo <= window)
        lo, hi = lo[fits], hi[fits]
        a, b = np.searchsorted(lo, i[open_]), np.searchsorted(hi, i[open_] + window, side="right")
        some = a < b
        at, a, b, open_ = open_[some], a[some], b[some], open_[~some]
        if len(at):
            key = hashes(lo, hi)
            best = least_of_ranges(key, a, b)
            chosen[at], start[at] = key[best], lo[best]
    d = doc[i]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (chosen[1:] != chosen[:-1]) | (d[1:] != d[:-1])]) if len(i) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(i)]]) - 1 if len(at) else at
    i0, i1 = i[at], i[last]
    digests = np.frombuffer(b"".join(words.digests(i0, i1 + window)), np.int64).reshape(-1, 2)
    first = words.first[d[at]]
    return {"doc": d[at], "key": chosen[at], "s1": digests[:, 0], "s2": digests[:, 1], "i0": i0 - first, "i1": i1 - first}


def least_of_ranges(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the least of each ``key[a:b]`` is, by tables over powers of two; the leftmost wins ties."""
    tagged = (mix(key) >> PLACE_BITS << PLACE_BITS) | np.arange(len(key), dtype=U)
    level = np.frexp((b - a).astype(float))[1] - 1
    out, table = np.empty(len(a), np.int64), tagged
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        out[at] = (np.minimum(table[a[at]], table[b[at] - (1 << k)]) & ((U(1) << PLACE_BITS) - U(1))).astype(np.int64)
        step = 1 << k
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
    return out


def segments(text: bytes, window: int, most: int | None = None) -> Iterator[tuple[int, int, bytes, bytes]]:
    """``base, own, piece, behind`` of a text: the number of words before a piece and in it."""
    base = 0
    for piece, behind in pieces_of(text, most or SLICE_BYTES, window - 1):
        own = len(piece.split())
        yield base, own, piece, behind
        base += own


STRETCH = "array<struct<key:long,s1:long,s2:long,i0:int,i1:int>>"


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One pass: ``doc_id, th, n_words, q1, q2, full_sha, stretches``, a row for each piece of a document.

    What describes the whole document stands in the row of its last piece, elsewhere there are nulls.
    """
    fields = [("key", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("i0", pa.int32()), ("i1", pa.int32())]
    names = ["doc_id", "th", "n_words", "q1", "q2", "full_sha", "stretches"]
    most = SLICE_BYTES  # travels with the function

    def rows_of(group: list[tuple]) -> pa.RecordBatch:
        rows = choose(Words([g[0] for g in group]), window)
        where = np.searchsorted(rows["doc"], np.arange(len(group) + 1)).astype(np.int32)
        base = np.array([g[1] for g in group])[rows["doc"]]
        cols = [rows["key"].view(np.int64), rows["s1"], rows["s2"], (rows["i0"] + base).astype(np.int32), (rows["i1"] + base).astype(np.int32)]
        lists = pa.ListArray.from_arrays(
            pa.array(where), pa.StructArray.from_arrays([pa.array(c) for c in cols], fields=[pa.field(*f) for f in fields])
        )
        told = list(zip(*(g[2:] for g in group), strict=True))
        kinds = [*[pa.int64()] * 5, pa.string()]
        return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(told, kinds, strict=True)], lists], names)

    def run(batches):
        for batch in pieces(batches):
            group, size = [], 0
            ids, ths = batch["doc_id"].to_pylist(), batch["th"].to_pylist()
            for doc_id, th, text in zip(ids, ths, batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                sha, n, of_doc = hashlib.sha256(), 0, []
                for base, own, piece, behind in segments(text or b"", window, most):
                    if own:
                        sha.update((b" " if base else b"") + b" ".join(piece.split()))
                    n += own
                    if of_doc:
                        group.append((*of_doc, doc_id, th, None, None, None, None))
                        size += len(of_doc[0])
                    of_doc = [piece + behind, base]
                    if size >= most:
                        yield rows_of(group)
                        group, size = [], 0
                q1, q2 = np.frombuffer(sha.digest()[:16], np.int64).tolist()
                group.append((*of_doc, doc_id, th, n, q1, q2, sha.hexdigest()))
                size += len(of_doc[0])
                if size >= most:
                    yield rows_of(group)
                    group, size = [], 0
            if group:
                yield rows_of(group)

    schema = f"doc_id long, th long, n_words long, q1 long, q2 long, full_sha string, stretches {STRETCH}"
    return identified(docs).mapInArrow(tidy(run), schema)


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, th, text``: ``th`` tells rows that share a ``doc_id`` apart by their text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def window_hashes(words: Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The range hash of the windows that start at ``at``, and 64 bits of the digest of their words."""
    return RangeHash(words.hashes)(at, at + window).view(np.int64), np.frombuffer(b"".join(words.digests(at, at + window, 8)), np.int64)


def window_rows(candidates: DataFrame, window: int = WINDOW) -> DataFrame:
    """``w1, w2, doc_id, th``: the different windows in ``ranges`` of ``doc_id, th, text, ranges``, by pieces."""
    most = SLICE_BYTES

    def run(batches):
        for batch in pieces(batches):
            cols = (batch["doc_id"].to_pylist(), batch["th"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["ranges"].to_pylist())
            for doc_id, th, text, ranges in zip(*cols, strict=True):
                lo, hi = np.array([r["i0"] for r in ranges]), np.array([r["i1"] for r in ranges])
                for base, own, piece, behind in segments(text, window, most):
                    words = Words([piece + behind])
                    asked = np.zeros(own + 1, np.int64)
                    a, b = np.clip(lo - base, 0, own), np.clip(hi + 1 - base, 0, own)
                    np.add.at(asked, a, 1)
                    np.add.at(asked, b, -1)
                    w = np.stack(window_hashes(words, np.flatnonzero(np.cumsum(asked[:own]) > 0), window))
                    w1, w2 = np.unique(w, axis=1)
                    n = len(w1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w1), pa.array(w2), pa.array([doc_id] * n, pa.int64()), pa.array([th] * n, pa.int64())], ["w1", "w2", "doc_id", "th"]
                    )

    return candidates.mapInArrow(tidy(run), "w1 long, w2 long, doc_id long, th long")


def find_repeats(docs: DataFrame, window: int = WINDOW, t: Tables | None = None) -> tuple[DataFrame, DataFrame]:
    """The scan without stretches, and what goes: ``doc_id, th, ranges`` (words ``i0`` to before ``i1``), ``windows`` (hashes).

    They read ``scan`` and ``removed`` of the tables ``t``.
    """
    t = t or Tables("substring")
    scanned = t(scan(docs, window), "scan")
    base = scanned.drop("stretches").where("full_sha IS NOT NULL")
    long_ = base.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    first = long_.groupBy("q1", "q2", "n_words").agg(F.min("doc_id").alias("m"), F.count("*").alias("n")).where("n > 1")
    first = t(first.drop("n"), "copies")
    copies = long_.join(first, ["q1", "q2", "n_words"]).where("doc_id > m")
    copies = t(copies.select("doc_id", "th", "n_words").distinct(), "copied")

    own = scanned.where(F.col("doc_id").isNotNull()).select("doc_id", "th", "stretches")
    own = own.join(copies.select("doc_id", "th"), ["doc_id", "th"], "left_anti")
    rows = own.select("doc_id", "th", F.inline("stretches"))
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    # Aggregates are written before they are joined: the join is dealt by an exchange that AQE may split at a hot key.
    shared = t(shared.select("key"), "keys")
    rows_shared = t(rows.join(by_shuffle(shared), "key"), "shared")

    stretch = rows_shared.groupBy("key", "s1", "s2").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x"))
    stretch = t(stretch, "stretch")
    many = stretch.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("many"))
    known = rows_shared.join(stretch.where("m < x").drop("x"), ["key", "s1", "s2"], "left")
    known = t(known.join(t(many, "many"), "key", "left"), "known")
    t.drop("keys", "shared", "stretch", "many")
    whole = known.where("doc_id > m").select("doc_id", "th", "i0", (F.col("i1") + window).alias("i1"))

    single = known.where("many AND (m IS NULL OR doc_id = m)").select("doc_id", "th", "i0", "i1")
    ranges = F.collect_list(F.struct("i0", "i1")).alias("ranges")
    asked = t(single.groupBy("doc_id", "th").agg(ranges), "asked")
    windows = t(window_rows(identified(docs).join(by_shuffle(asked), ["doc_id", "th"]), window), "windows")
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x")
    found = windows.join(t(least, "least"), ["w1", "w2"]).where("doc_id > m")
    one = found.select("doc_id", "th", F.struct("w1", "w2").alias("w")).groupBy("doc_id", "th").agg(F.collect_list("w").alias("windows"))
    copied = copies.select("doc_id", "th", F.lit(0).alias("i0"), F.col("n_words").cast("int").alias("i1"))
    whole = whole.union(copied).distinct().groupBy("doc_id", "th").agg(ranges)
    removed = t(whole.join(one, ["doc_id", "th"], "full"), "removed")
    t.drop("copies", "copied", "known", "asked", "windows", "least")
    return base, removed


def _kept(text: bytes, ranges: list[dict] | None, windows: list[dict] | None, window: int, most: int | None = None) -> Iterator[tuple[bytes, np.ndarray]]:
    """``piece, keep`` of a text: which words of each piece stay, outside ``ranges`` and windows with the hashes of ``windows``."""
    found = list(segments(text, window, most))
    steps = np.zeros(sum(own for _, own, _, _ in found) + 1, np.int32)
    np.add.at(steps, [r["i0"] for r in ranges or []], 1)
    np.add.at(steps, [r["i1"] for r in ranges or []], -1)
    known = np.unique([w["w1"] for w in windows or []])
    exact = {(w["w1"], w["w2"]) for w in windows or []}
    for base, own, piece, behind in found if exact else ():
        words = Words([piece + behind])
        at = np.arange(max(0, min(own, len(words.hashes) - window + 1)))
        w1 = RangeHash(words.hashes)(at, at + window).view(np.int64)
        at = at[np.isin(w1, known)]
        at = at[[pair in exact for pair in zip(*(w.tolist() for w in window_hashes(words, at, window)), strict=True)]] if len(at) else at
        np.add.at(steps, base + at, 1)
        np.add.at(steps, base + at + window, -1)
    keep = np.cumsum(steps[:-1]) == 0
    for base, own, piece, _ in found:
        yield piece, keep[base : base + own]


def repeat_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    base, removed = find_repeats(docs, window)
    most = SLICE_BYTES

    def run(batches):
        for batch in pieces(batches):
            n, hexes = [], []
            lists = (batch["ranges"].to_pylist(), batch["windows"].to_pylist())
            for text, ranges, windows in zip(batch["text"].cast(pa.binary()).to_pylist(), *lists, strict=True):
                sha, gone, some = hashlib.sha256(), 0, False
                for piece, keep in _kept(text or b"", ranges, windows, window, most):
                    gone += int(len(keep) - keep.sum())
                    if keep.any():
                        sha.update((b" " if some else b"") + b" ".join(itertools.compress(piece.split(), keep.tolist())))
                        some = True
                n.append(gone)
                hexes.append(sha.hexdigest())
            cols = [batch["doc_id"], batch["th"], pa.array(n, pa.int64()), pa.array(hexes, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "n_removed", "sha"])

    texts = identified(docs).join(by_shuffle(removed), ["doc_id", "th"]).select("doc_id", "th", "text", "ranges", "windows")
    cut = texts.mapInArrow(tidy(run), "doc_id long, th long, n_removed long, sha string").distinct()
    out = base.select("doc_id", "th", "n_words", "full_sha").join(cut, ["doc_id", "th"], "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("sha", "full_sha").alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated words cut out of their texts; those of which nothing is left go."""
    t = Tables("substring")
    _, removed = find_repeats(docs, window, t)
    t.drop("scan")
    columns, schema, most = docs.columns, docs.schema, SLICE_BYTES
    marked = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__th": F.xxhash64("text")})
    removed = removed.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.struct("ranges", "windows").alias("__gone"))
    marked = marked.join(by_shuffle(removed), ["__id", "__th"], "left")

    def run(batches):
        for batch in pieces(batches):
            texts = batch["text"].to_pylist()
            for k, gone in enumerate(batch["__gone"].to_pylist()):
                if gone:
                    texts[k] = cut_text(texts[k], gone["ranges"], gone["windows"], window, most)
            cols = {c: batch[c] for c in columns}
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    out = marked.select(*columns, "__gone").mapInArrow(tidy(run), schema)
    return out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def cut_text(text: str, ranges: list[dict] | None, windows: list[dict] | None, window: int = WINDOW, most: int | None = None) -> str:
    """``text`` without those words and the blanks after them; the rest keeps its own blanks."""
    parts = []
    for piece, keep in _kept(text.encode(), ranges, windows, window, most):
        starts = np.append(Words([piece]).start, len(piece))
        if not parts:
            parts.append(piece[: starts[0]])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            parts.append(piece[starts[a] : starts[b]])
    return b"".join(parts).decode().strip()
