"""Near-duplicates, repeated substrings and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from siftlake.llm import common, minhash, substring, wordhash
from siftlake.llm.common import connected_components

WINDOW = 50


def vocabulary(seed, n=4000):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(seed=1):
    rng, words = random.Random(seed), vocabulary(seed)
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, docs = text(70), []
    for _ in range(60):
        docs.append(text(rng.randint(1, 200)))
    for k in range(12):  # a passage in the middle, at the start and at the end
        body = text(90)
        at = (0, 45, 90)[k % 3]
        docs.append(body[:at] + passage[k % 5 : 70 - k % 3] + body[at:])
    base = text(150)
    for k in range(40):  # near copies of one text
        copy = [*base]
        for _ in range(k // 4):
            copy[rng.randrange(150)] = rng.choice(words)
        docs.append(copy)
    docs += [docs[3], docs[3], docs[60], ["x"] * 200, ["x"] * 120, ["x", "y"] * 90, text(30) * 5, docs[-1][:49], []]
    rows = [(i + 1, " \n\t"[i % 3].join(d)) for i, d in enumerate(docs)]
    rng.shuffle(rows)
    return [*rows, (None, " ".join(passage)), (None, None), (500, None), (501, ""), (502, "  "), (7, rows[0][1])]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "length(text) AS n_chars", "'a' AS th", "1 AS n_words", "2 AS class_id")


def kept_by_hand(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - WINDOW + 1):
                g = tuple(w[k : k + WINDOW])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        keep = [True] * len(w)
        if i is not None:
            for k in range(len(w) - WINDOW + 1):
                if first[tuple(w[k : k + WINDOW])] < i:
                    keep[k : k + WINDOW] = [False] * WINDOW
        out.append((i, w, [x for x, y in zip(w, keep, strict=True) if y]))
    return out


@pytest.mark.parametrize("seed,bytes_", [(1, substring.SLICE_BYTES), (2, substring.SLICE_BYTES), (1, 300), (3, 700)])
def test_repeat_digest(spark, monkeypatch, seed, bytes_):
    """Also with texts in many overlapping pieces."""
    monkeypatch.setattr(substring, "SLICE_BYTES", bytes_)
    rows = corpus(seed)
    want = Counter((i, len(w), len(w) - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for i, w, k in kept_by_hand(rows))
    got = substring.repeat_digest(frame(spark, rows))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want
    assert substring.repeat_digest(frame(spark, [])).count() == 0


def test_every_window_has_a_symbol_that_its_words_decide():
    """Equal windows pick equal symbols, in whole texts and in pieces."""
    rng, words = random.Random(8), vocabulary(8, 60)
    passage = [rng.choice(words) for _ in range(300)] + ["x"] * 120 + ["x", "y"] * 40
    texts = [[rng.choice(words) for _ in range(90)] + passage + [rng.choice(words)], passage, ["x"] * 300, passage[100:] * 2]
    seen = {}
    for most in (1 << 20, 150, 901):
        for text in texts:
            raw, at = " \n".join(text).encode(), 0
            for piece, behind in wordhash.pieces_of(raw, most, WINDOW - 1):
                found = substring.choose(wordhash.Words([piece + behind]))
                for key, i0, i1 in zip(found["key"].tolist(), found["i0"].tolist(), found["i1"].tolist(), strict=True):
                    for i in range(at + i0, at + i1 + 1):
                        seen.setdefault(tuple(text[i : i + WINDOW]), set()).add(key)
                at += len(piece.split())
            assert at == len(text)
    assert all(len(v) == 1 for v in seen.values())
    assert {g for t in texts for g in (tuple(t[i : i + WINDOW]) for i in range(len(t) - WINDOW + 1))} == seen.keys()


def test_pieces_of_long_texts():
    text = b"  ab c\n\n" + b"d" * 50 + b" e \x0b f " * 20 + b"g  "
    for most in (1, 2, 7, 30, 10**6):
        found = [*wordhash.pieces_of(text, most, 3)]
        assert b"".join(p for p, _ in found) == text and all(not p[:1].isspace() for p, _ in found[1:])
        for k, (p, behind) in enumerate(found):
            rest = b"".join(q for q, _ in found[k + 1 :])
            assert rest.startswith(behind) and behind.split() == rest.split()[:3]
    assert [*wordhash.pieces_of(b"", 5, 3)] == [(b"", b"")]


def test_long_text_in_bounded_memory():
    """A text of 24 MB takes a few times its size, not some forty times."""
    import tracemalloc

    raw = b" ".join(b"w%d" % (k % 7001) for k in range(4_000_000))
    tracemalloc.start()
    n = sum(len(substring.choose(wordhash.Words([piece + behind]))["key"]) for _, _, piece, behind in substring.segments(raw, WINDOW))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 100_000 and peak < 6 * len(raw)


@pytest.mark.parametrize("bytes_", [substring.SLICE_BYTES, 300])
def test_remove_repeats(spark, monkeypatch, bytes_):
    monkeypatch.setattr(substring, "SLICE_BYTES", bytes_)
    rows = corpus()
    df = frame(spark, rows)
    out = substring.remove_repeats(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, tuple(r.text.encode().split())) for r in out.collect())
    assert got == Counter((i, tuple(k)) for i, _, k in kept_by_hand(rows) if k)
    assert substring.cut_text("a\n b  c d", [{"i0": 1, "i1": 2}], None) == "a\n c d"
    assert substring.cut_text("a\n b  c d", None, None) == "a\n b  c d"


def shingle_counts(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None


def classes_by_hand(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_counts(t))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = [(i, s) for i, ss in sets.items() for s in ss if s]
    for n, (i, a) in enumerate(items):
        for j, b in items[:n]:
            both = sum((a & b).values())
            if both >= 0.8 * (sum(a.values()) + sum(b.values()) - both) - 1e-9:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("small", [16, 1])
def test_classes(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = corpus()
    got = minhash.classes(frame(spark, rows))
    assert {r.doc_id: r.class_id for r in got.collect()} == classes_by_hand(rows)
    assert minhash.classes(frame(spark, [])).count() == 0


@pytest.mark.parametrize("small", [16, 1])
def test_classes_of_ids_with_several_texts(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    words = vocabulary(9)
    rng = random.Random(4)
    text = [[rng.choice(words) for _ in range(120)] for _ in range(12)]
    near = lambda k: " ".join([*text[k][:-1], "other"])
    rows = [(5, " ".join(text[k])) for k in range(10)] + [(20 + k, near(k)) for k in range(10)]  # ten texts of one id
    rows += [(40, " ".join(text[10])), (41, near(10)), (50, " ".join(text[11])), (51, near(11)), (60, " ".join(text[10])), (60, near(11))]
    rows += [(70, None), (70, " ".join(text[11])), (71, None), (1, "short")]
    got = minhash.classes(frame(spark, rows)).collect()
    by_hand = classes_by_hand(rows)
    assert len(got) == len(rows) and {(r.doc_id, r.class_id) for r in got} == set(by_hand.items())
    assert {by_hand[i] for i in (40, 41, 50, 51, 60, 70)} == {40} and by_hand[29] == 5


def test_keep_one(spark):
    """One document of each class, the smallest id; 7 has two texts, which stay together or go together."""
    rows = corpus()
    df = frame(spark, rows)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    by_hand = classes_by_hand(rows)
    want = Counter(r for r in rows if r[0] is None or by_hand[r[0]] == r[0])
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want and len(by_hand) > len({*by_hand.values()})
    assert minhash.keep_one(frame(spark, [])).count() == 0


def test_blocks_by_shingles(spark, monkeypatch):
    """Long texts make blocks of their own."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 1)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 200)
    rows = corpus(3)
    assert {r.doc_id: r.class_id for r in minhash.classes(frame(spark, rows)).collect()} == classes_by_hand(rows)


def test_long_texts_by_pieces(spark, monkeypatch):
    """Pieces give the shingles, their times and the hashes of the whole text."""
    rng, words = random.Random(5), vocabulary(5, 50)
    for n in (0, 1, 4, 5, 6, 400):
        text = ", ".join(rng.choice(words) for _ in range(n)).encode()
        doc, element, times, count, whole = minhash.gather([b"x y", text, b"z"], 1 << 20)
        for most in (1, 20, 77):
            found, again, n_words, hashes = minhash.long_shingles(text, most)
            mine = doc == 1
            assert (found == element[mine]).all() and (again == times[mine]).all() and n_words == count[1] == n
            assert hashes == [w[1] for w in whole]
    monkeypatch.setattr(minhash, "SLICE_BYTES", 200)
    rows = corpus(4)
    assert {r.doc_id: r.class_id for r in minhash.classes(frame(spark, rows)).collect()} == classes_by_hand(rows)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 2**64, 400, dtype=np.uint64)
    wa, wb = rng.integers(0, 4, 400), rng.integers(0, 4, 400)
    doc = np.concatenate([np.zeros(400, int), np.ones(400, int)])
    weight = np.concatenate([wa, wb])
    use = weight > 0
    sig = minhash.dart_signatures(doc[use], np.concatenate([elements, elements])[use], weight[use], 2, 4096)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (5, 5)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 300: 100}


def test_components_settle(spark):
    """As many rounds as it takes, and no table of an earlier round stays."""
    common_paths = [*common._written]
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000 + 7 * i % 31, 1000 + 7 * (i + 1) % 31) for i in range(30)] + [(2000, 2000 + i) for i in range(90)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = dict.fromkeys(range(1, 301), 1) | dict.fromkeys(range(1000, 1031), 1000) | dict.fromkeys(range(2000, 2090), 2000)
    assert {r.node: r.component for r in got} == want
    assert len(common._written) == len(common_paths) + 1
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


SCHEMA = "doc_id long, text string, lang string, source string"


def pipeline_by_hand(rows):
    """The words of the documents that the stages before packing leave."""
    good = [(i, t) for i, t, *_ in rows if t and len(t.split()) >= 20]
    by_hand = classes_by_hand(good)
    return [(i, k) for i, _, k in kept_by_hand([(i, t) for i, t in good if i is None or by_hand[i] == i]) if k]


def check_pipeline(spark, folder, rows, more=()):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    tokenizers = pytest.importorskip("tokenizers")
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars", *more)
    df.write.parquet(f"{folder}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(folder)).collect()
    left = pipeline_by_hand(rows)
    assert {r.doc_id for r in pieces} == {i for i, _ in left}
    tok = tokenizers.Tokenizer.from_file(corpus_pipeline.tokenizer_path("word_bpe_49k.json"))
    want = sum(len(tok.encode(b" ".join(k).decode(), add_special_tokens=False).ids) + 1 for _, k in left)
    assert sum(r.length for r in pieces) == want
    return left


def test_pipeline(spark, tmp_path):
    words = vocabulary(9)
    rng = random.Random(9)
    rows = []
    for i in range(80):
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 120))), "en", f"s{i % 4}"))
    rows.append((200, rows[40][1], "en", "s1"))
    rows.append((201, rows[41][1] + " " + " ".join(rng.choice(words) for _ in range(300)), "en", "s1"))
    assert len(check_pipeline(spark, tmp_path, rows)) > 50


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns with the operators' own names."""
    words = vocabulary(10)
    rng = random.Random(10)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(60), "en", f"s{i % 3}") for i in range(20)]
    rows += [(None, text(60), None, None), (None, rows[3][1], None, "s1"), (30, None, None, None), (31, "", "en", ""), (32, "  \n", "en", None)]
    rows += [(33, text(30), None, ""), (33, text(40), "en", "s1"), rows[5], rows[5], (34, rows[5][1], "de", None), (35, text(30_000), "en", "s2")]
    more = ["1 AS th", "'x' AS host", "true AS host_failed", "2 AS class_id", "3 AS start", "array(1) AS ranges", "'y' AS kept", "4 AS row", "5 AS size"]
    assert {None, 33, 35} <= {i for i, _ in check_pipeline(spark, tmp_path, rows, more)}


def test_pipeline_of_nothing(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], f"{SCHEMA}, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
