"""Cached encoders, packing, the id store and BPE against the tokenizers library on odd texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from siftlake.llm import bpe, idstore, packing, tokens  # noqa: E402
from siftlake.llm.common import scratch  # noqa: E402

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ROWS = [
    (5, "The cat sat.\nOn the mat"), (1, None), (2, ""), (3, "straße <|endoftext|> don't"), (3, "same id"), (3, "same id"), (None, "no id"),
    (9, "x" * 3000 + " " + "ab " * 2500), (7, "中文 ½ ﬁ  \t \n end "), (8, "word " * 900),
]
SCHEMA = "doc_id long, text string"


def texts(n=3000):
    rng = random.Random(1)
    alphabet = [*"aabcdeéñß 1²'’s.,!?-\n\t\r\x0b\x1c\x85\xa0\u2028\u3000\u200b中ゃ한😀\u0301ΣςİſﬁĀ", "<|endoftext|>", "<|startoftext|>", "'s", "  ", "\x00"]
    for k in range(n):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        yield s if k % 3 else " ".join(rng.choice(["the", "Haus.", "été", "x1", "don't", "a\nB", "\n", "A.\nCd", ""]) for _ in range(6))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_equal_whole_texts(path):
    tok, encode = tokenizers.Tokenizer.from_file(path), tokens.library_encoder(path)
    cases = [*texts()]
    want = [tok.encode(t, add_special_tokens=False).ids for t in cases]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(cases)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(cases)] == want  # from the cache


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_very_long_texts_equal_whole_ones(path):
    """Long texts are cut before single blanks; ids are those of the whole text, also where no blank can be found."""
    rng = random.Random(6)
    words = ["the", "Haus.", "été", "don't", "x1", "中文", "a\nB", "", "\n", "A.\x1cCd", "\u00a0"]
    text = " ".join(rng.choice(words) for _ in range(900_000))
    assert len(text) > 2 * tokens.GROUP_CHARS
    encode, tok = tokens.library_encoder(path), tokenizers.Tokenizer.from_file(path)
    cut = [*encode.parts(text)]
    assert len(cut) > 1 and "".join(cut) == text
    for t in (text, "y\n" * (tokens.GROUP_CHARS + 9)):
        assert np.frombuffer(encode([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_kept_chunks_turn_over():
    """Frequent chunks stay over the turn of generations, and ids do not depend on what is kept."""
    asked = []
    cache = tokens.ChunkCache(str.split, lambda _, chunk: asked.append(chunk) or chunk.encode(), [], str.encode, 9, entries=20)
    for k in range(200):
        assert cache([f"hot w{k} {'long' * 99}"]) == [f"hotw{k}{'long' * 99}".encode()]
    assert asked.count("hot") == 1 and len(cache.cache) <= 12 and len(cache.cache.old) <= 12
    assert asked.count("long" * 99) == 200  # long chunks are not kept


def test_rank_array_equals_library():
    tok, model = tokenizers.Tokenizer.from_file(BYTE), bpe.model(BYTE)
    cases = [*texts(), "ab" * 500 + "é" * 3000 + "x" * 5000]
    for t, ids in zip(cases, model.encode(cases), strict=True):
        want = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert model.decode(ids) == tok.decode(want, skip_special_tokens=False)
    broken = np.array([50256, 255, 188], "<u4")
    assert model.decode(broken.tobytes()) == tok.decode(broken.tolist(), skip_special_tokens=False)


def test_long_and_short_merge_alike():
    model, rng = bpe.model(BYTE), random.Random(2)
    for _ in range(300):
        ids = [model.single[rng.choice(b"abethin \xc3\xa9")] for _ in range(rng.randint(1, 60))]
        assert model._short([*ids]) == model._long([*ids])


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 AS start", "'x' AS length", "2 AS n_tokens")  # names that clash


def test_round_trip_query(spark):
    tok = tokenizers.Tokenizer.from_file(BYTE)
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(frame(spark), BYTE).collect())
    want = []
    for i, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip(frame(spark, []), BYTE).count() == 0
    assert bpe.encode_documents(frame(spark), BYTE).where("doc_id = 2").first().ids == []


def test_packing(spark):
    tok = tokenizers.Tokenizer.from_file(WORD)
    rows = packing.pack(frame(spark), WORD, 1, 512, keep_ids=True).collect()
    whole = sorted((i or -1, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in ROWS)
    # Each id lies in one piece: pieces by document and length of the document make up the texts again.
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in whole)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        assert any(i == (r.doc_id or -1) and w[r.start : r.start + r.length] == ids.tolist() and len(w) == r.doc_tokens for i, w in whole)
    packs = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert packs.get(r.sequence_id, 0) == r.offset
        packs[r.sequence_id] = r.offset + r.length
    assert max(packs.values()) <= 512 and sorted(packs) == list(range(len(packs)))
    assert packing.pack(frame(spark, []), WORD, 1, 512).count() == 0


def test_ranks_over_many_buckets(spark, monkeypatch):
    """A length that most pieces have is ranked in many buckets; every place is taken once."""
    monkeypatch.setattr(packing, "RANKED", 5)
    rows = [(None, None)] * 60 + [(k, "word " * (600 + k % 3)) for k in range(40)]
    packs = {}
    for r in packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(5), WORD, 1, 256).collect():
        packs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in packs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(packs) == list(range(len(packs)))


def test_patterns_hold_the_histogram():
    rng = random.Random(3)
    for size in (8, 64, 2048):
        histogram = {rng.randint(1, size): rng.randint(1, 1000) for _ in range(60)}
        patterns = packing.shortest_pack_first(histogram, size)
        held = {}
        for packs, pattern in patterns:
            assert packs > 0 and sum(length * k for length, k in pattern) <= size
            for length, k in pattern:
                held[length] = held.get(length, 0) + packs * k
        assert held == histogram and len(patterns) <= 2 * size + 2


def test_store(spark):
    tok = tokenizers.Tokenizer.from_file(BYTE)
    path = scratch(spark, "test-store")
    idstore.write_store(frame(spark), path, BYTE, 2)
    rows = idstore.read_store(spark, path, idstore.all_keys(frame(spark)), keep_ids=True).collect()
    want = sorted((i if i is not None else -1, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in ROWS)
    got = sorted((r.doc_id if r.doc_id is not None else -1, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert got == want
    start = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    other = spark.createDataFrame([(404, 0), (3, 2), (3, 3)], "doc_id long, nth long")
    assert [(r.doc_id, r.nth) for r in idstore.lookup(spark, path, other).collect()] == [(3, 2)]


def test_ids_beyond_two_bytes(spark, tmp_path):
    """The width follows the tokenizer's largest id; a width that does not hold an id raises."""
    assert idstore.shard_ids(np.array([65535]), 2) == b"\xff\xff"
    with pytest.raises(OverflowError, match="70000"):
        idstore.shard_ids(np.array([1, 70000]), 2)
    words = [f"w{k}" for k in range(70_001)]
    tok = tokenizers.Tokenizer(tokenizers.models.WordLevel({w: k for k, w in enumerate(words)}, unk_token="w0"))
    tok.normalizer, tok.pre_tokenizer = tokenizers.normalizers.Lowercase(), tokenizers.pre_tokenizers.WhitespaceSplit()
    tok.save(f"{tmp_path}/big.json")
    path = scratch(spark, "test-store")
    df = spark.createDataFrame([(1, "w5 w70000"), (2, "w65536")], SCHEMA)
    idstore.write_store(df, path, f"{tmp_path}/big.json", 2)
    rows = idstore.read_store(spark, path, idstore.all_keys(df), keep_ids=True).orderBy("doc_id").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == [[5, 70000, 2], [65536, 2]]


def test_frequent_keys_over_many_shards(spark, monkeypatch):
    """A third of the rows without id and a third with one id: they lie in several shards and all are found."""
    monkeypatch.setattr(idstore, "RUN", 7)
    rows = [(None, f"null {k}") for k in range(60)] + [(4, f"four {k}") for k in range(60)] + [(100 + k, "x") for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    path = scratch(spark, "test-store")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        manifest = idstore.write_store(df, path, BYTE, 2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert manifest.count() > 6
    keys = idstore.all_keys(df)
    assert sorted((r.doc_id or -1, r.nth) for r in keys.collect())[:60] == [(-1, k) for k in range(60)]
    tok = tokenizers.Tokenizer.from_file(BYTE)
    got = sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in idstore.read_store(spark, path, keys, keep_ids=True).collect())
    assert got == sorted((i or -1, [*tok.encode(t, add_special_tokens=False).ids, 2]) for i, t in rows)


def test_colliding_hashes_get_another_seed(monkeypatch):
    import pyarrow as pa

    ids, nth = pa.chunked_array([pa.array([1, 2, None], pa.int64())]), pa.chunked_array([pa.array([0, 0, 0], pa.int64())])
    plain = idstore.hashes
    monkeypatch.setattr(idstore, "hashes", lambda d, n, seed: (np.zeros(3, np.uint64), np.zeros(3, np.uint32)) if seed == 0 else plain(d, n, seed))
    seed, key, _ = idstore.distinct_hashes(ids, nth)
    assert seed == 8 and len({*key.tolist()}) == 3
    with pytest.raises(ValueError, match="not distinct"):
        idstore.distinct_hashes(pa.chunked_array([pa.array([1, 1], pa.int64())]), pa.chunked_array([pa.array([0, 0], pa.int64())]))


def test_empty_store(spark):
    path = scratch(spark, "test-store")
    idstore.write_store(frame(spark, []), path, BYTE, 2)
    assert idstore.read_store(spark, path, idstore.all_keys(frame(spark, []))).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 20000, dtype=np.uint64))
    mph = idstore.PerfectHash.build(keys)
    assert sorted(mph(keys).tolist()) == list(range(len(keys)))
    again = idstore.PerfectHash.load(mph.arrays())
    assert (again(keys) == mph(keys)).all()
