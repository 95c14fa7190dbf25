import base64
import gzip
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.llm import ann, warc
from siftlake.llm.common import filesystem, scratch

PAGES = [
    (1, "http://a/", "<p>same</p>"), (2, "http://b/\r\nX: y", "<p>same</p>"), (3, None, None), (4, "http://d/", ""), (5, "http://e/é", "é\r\n\r\nWARC/1.1\r\n"),
    (6, "http://f/", "x" * 300_000), (7, "http://g/", "<p>same</p>"), (7, "http://g/", "<p>same</p>"), (None, "http://h/", "<p>same</p>"),
]


def write(spark, rows=PAGES, **kw):
    path = scratch(spark, "test-warc")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"keep": F.lit(1), "record_type": F.lit("x")})
    warc.write_warc(df.repartition(3), path, **kw)
    return path


def test_round_trip(spark):
    path = write(spark)
    rows = warc.read_warc(spark, path).collect()
    assert len(rows) == len(PAGES)
    response = {"<p>same</p>": 7, "": 4}
    for r in rows:
        html = next((h or "" for i, _, h in PAGES if i == r.page_id), "<p>same</p>")
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert r.payload_bytes == len(html.encode())
        keep = response.get(html, r.page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == keep else ("revisit", keep))
        assert r.payload == (html if r.record_type == "response" else None)
    assert next(r.target_uri for r in rows if r.page_id == 2) == "http://b/%0D%0AX:%20y"


def test_pushdown_and_pruning(spark):
    path = write(spark)
    df = warc.read_warc(spark, path, ["page_id", "record_type"])
    assert sorted(r.page_id for r in df.where("record_type = 'revisit' AND page_id < 3").collect()) == [1, 2]
    assert df.columns == ["page_id", "record_type"]
    only = spark.read.format("warc").option("recordTypes", "revisit").load(path)
    assert only.count() == 4 and only.where("record_type IN ('response')").count() == 0
    reader = warc.WarcReader({"path": path}, df.schema)
    rest = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), "x")]))
    assert len(rest) == 1 and reader.wanted == {"record_type": {"revisit"}}


def test_archives_are_plain_gzip(spark):
    path = write(spark)
    fs, root = filesystem(path)
    names = [i.path for i in fs.get_file_info(__import__("pyarrow").fs.FileSelector(root)) if i.path.endswith(".gz")]
    data = b"".join(gzip.decompress(fs.open_input_file(n).read()) for n in names)
    assert data.count(b"WARC/1.1\r\nWARC-Type:") == len(PAGES)


def test_foreign_members(spark):
    """Records without the length field, and uncompressed ones."""
    path = scratch(spark, "test-warc")
    fs, root = filesystem(path)
    fs.create_dir(root)
    records = [warc.record(i, f"http://{i}/", b"body %d" % i, "response", None, "2020-01-01T00:00:00Z") for i in range(5)]
    with fs.open_output_stream(f"{root}/a.warc.gz", compression=None) as f:
        f.write(b"".join(map(gzip.compress, records)))
    with fs.open_output_stream(f"{root}/b.warc") as f:
        f.write(b"".join(records))
    rows = warc.read_warc(spark, path, ["page_id", "payload"]).where("page_id > 2").collect()
    assert sorted((r.page_id, r.payload) for r in rows) == [(3, "body 3"), (3, "body 3"), (4, "body 4"), (4, "body 4")]


def archive(spark, path):
    """A reader's rows for the single file of an archive, in this process."""
    def rows(columns):
        schema = warc.read_warc(spark, path, columns).schema
        reader = warc.WarcReader({"path": path}, schema)
        return [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]

    return rows


def test_payloads_nobody_asked_for_stay_deflated(spark, monkeypatch):
    noise = "".join(map(chr, np.random.default_rng(1).integers(32, 0x2000, 50_000)))
    path = write(spark, [(k, f"http://{k}/", noise + str(k)) for k in range(20)])
    inflated = 0
    more = warc.Member._more

    def counted(self, most):
        nonlocal inflated
        before = len(self.data)
        out = more(self, most)
        inflated += len(self.data) - before
        return out

    monkeypatch.setattr(warc.Member, "_more", counted)
    rows = archive(spark, path)
    assert sorted(r["page_id"] for r in rows(["page_id", "record_type", "target_uri"])) == [*range(20)]
    assert 0 < inflated <= 20 * 4096
    inflated = 0
    assert {r["payload_bytes"] for r in rows(["payload_bytes"])} == {len((noise + "1").encode()), len((noise + "10").encode())}
    assert inflated > 20 * 100_000


@pytest.mark.parametrize("keep", [0.47, 0.999])
@pytest.mark.parametrize("kind", ["sized", "plain gzip", "text"])
def test_archives_cut_short_raise(spark, kind, keep):
    path = scratch(spark, "test-warc")
    fs, root = filesystem(path)
    fs.create_dir(root)
    records = [warc.record(i, f"http://{i}/", b"body %d " % i * 400, "response", None, "2020-01-01T00:00:00Z") for i in range(10)]
    pack = {"sized": warc.gzip_member, "plain gzip": gzip.compress, "text": bytes}[kind]
    data = b"".join(map(pack, records))
    name = f"{root}/a.warc" + (".gz" if kind != "text" else "")
    with fs.open_output_stream(name, compression=None) as f:
        f.write(data[: int(len(data) * keep)])
    for columns in (["page_id"], ["page_id", "payload"]):
        with pytest.raises(EOFError, match="archive ends within"):
            archive(spark, path)(columns)
    with fs.open_output_stream(name, compression=None) as f:
        f.write(data + (b"\r\n" if kind == "text" else b""))
    assert len(archive(spark, path)(["page_id"])) == 10


def test_long_payloads(spark):
    html = "é<p>" * 1_500_000
    row = warc.read_warc(spark, write(spark, [(1, "http://a/", html)])).first()
    assert row.payload == html and row.payload_bytes == len(html.encode())


def test_least_bytes_and_empty(spark):
    rows = warc.read_warc(spark, write(spark, least_bytes=100)).collect()
    assert all(r.record_type == "response" for r in rows)
    assert warc.read_warc(spark, write(spark, [])).count() == 0


def vectors(n, d=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact(x, ids, asks, k):
    out = {}
    for q in asks:
        score = np.array([np.dot(x[ids.index(q)].astype(float), v.astype(float)) for v in x])
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-round(score[j], 12), ids[j]))[:k]
        out[q] = [ids[j] for j in order]
    return out


def test_search_small_is_exact(spark):
    x = vectors(90)
    x[40:70] = x[40]  # equal vectors
    ids = [*range(90)]
    odd = [(100, None), (101, []), (102, [0.0] * 16), (103, [float("nan")] + [1.0] * 15), (104, [None] + [1.0] * 15), (105, [1.0] * 3), (120, [float("inf")] * 16), (None, [1.0] * 16)]
    rows = [(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)] + [(0, x[0].tolist(), 1)] + [(i, v, 1) for i, v in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = ann.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    want = exact(x, ids, range(0, 90, 20), 20)
    assert {q: [r.vec_id for r in got if r.query_id == q] for q in want} == want
    assert [r["rank"] for r in got if r.query_id == 0] == list(range(1, 21))
    assert {r.query_id for r in got} == set(want)


def ranked(df, k=20):
    out = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_ties_go_to_the_smaller_id_across_blocks(spark, monkeypatch):
    """Different vectors of equal scores, dealt over many blocks in any order."""
    monkeypatch.setattr(ann, "VECTORS", 13)
    monkeypatch.setattr(ann, "QUERIES", 2)
    x = np.zeros((90, 64))
    x[:, 0] = 0.5
    x[np.arange(90), 1 + np.arange(90) % 63] = np.where(np.arange(90) < 63, 0.25, -0.25)
    x[::20, 1:] = 0
    x[::20, 0] = 1.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ranked(spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>").repartition(5))
    for q, found in got.items():
        want = sorted(((float(x[q] @ x[i]), -i) for i in range(90) if i != q), reverse=True)[:20]
        assert found == [(-i, s) for s, i in want]


def test_rows_of_one_id_with_different_vectors(spark):
    """One of them takes part, the same in every order of the rows, as a query and as a candidate."""
    x = vectors(40)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[30].tolist()), (7, x[31].tolist()), (7, x[31].tolist())]
    one, other = (ranked(spark.createDataFrame(r, "vec_id long, embedding array<float>")) for r in (rows, rows[::-1]))
    assert one == other and {len(v) for v in one.values()} == {20}
    assert all(len({i for i, _ in v}) == 20 for v in one.values())


def test_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_BYTES", 1 << 18)
    x = vectors(60, 3000)
    got = ranked(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == exact(x, [*range(60)], [0, 20, 40], 5)


def test_recall_on_the_test_table(spark):
    """On ``embeddings`` of the test tables the neighbours are those of brute force, scores included."""
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    df = spark.read.parquet(path)
    got = ranked(df)
    table = df.toArrow()
    ids = table["vec_id"].to_numpy()
    x = ann.matrix(table["embedding"], 64) if len(table["embedding"][0]) == 64 else np.array(table["embedding"].to_pylist(), float)
    hits = 0
    for q in ids[ids % 20 == 0].tolist():
        score = x @ x[np.flatnonzero(ids == q)[0]]
        score[ids == q] = -np.inf
        top = np.lexsort((ids, -score))[:20]
        hits += len({i for i, _ in got[q]} & {*ids[top].tolist()})
        assert np.allclose([s for _, s in got[q]], np.sort(score)[::-1][:20], rtol=1e-12, atol=0)
    assert hits / (20 * len(got)) > 0.999


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 20, 5.0), (0, 3, 4.0), (20, 0, 5.0), (20, 3, 4.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTORS", 1500)
    monkeypatch.setattr(ann, "QUERIES", 64)
    x = vectors(4000, 32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, 20).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    score = x[::20].astype(float) @ x.astype(float).T
    np.put_along_axis(score, np.arange(0, 4000, 20)[:, None], -9, 1)
    top = np.argsort(-score, axis=1)[:, :20]
    recall = np.mean([len(found[20 * k] & set(t.tolist())) / 20 for k, t in enumerate(top)])
    assert recall >= 0.9


def test_large_groups_of_near_copies(spark):
    """More near copies in a block than are scored first: their codes are the same, their order is not."""
    x = vectors(3000, 64)
    near = np.random.default_rng(3).normal(size=(1200, 64))
    for first, to in ((0, 600), (600, 1200)):
        x[first:to] = x[first] + 0.002 * near[first:to]
    ids = [*range(3000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    score = x[::20].astype(float) @ x.astype(float).T
    np.put_along_axis(score, np.arange(0, 3000, 20)[:, None], -9, 1)
    top = np.argsort(-score, axis=1, kind="stable")[:, :20]
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert [found[20 * k] for k in range(len(top))] == top.tolist()


def test_error_bounds_hold():
    x = vectors(3000, 30).astype(float) * np.random.default_rng(5).uniform(0.01, 50, 3000)[:, None]
    book = ann.Codebook.fit(x[:1000])
    codes, q = book.packed(x), x[:50]
    tables = book.tables(q)
    score = sum(tables[:, b][:, codes[:, b]] for b in range(codes.shape[1]))
    slack = np.linalg.norm(q, axis=1)[:, None] * ann.error_bounds(book, x, codes)
    assert (np.abs(score - q @ x.T) <= slack).all()


def test_anisotropic_loss_is_lower():
    x = vectors(2000, 32).astype(float)
    book = ann.Codebook.fit(x)
    plain = ann.Codebook(book.words, 1.0)

    def loss(codes):
        e = (ann.Codebook.split(x) - book.words[np.arange(book.words.shape[0]), codes]).reshape(len(x), -1)
        along = (e * x).sum(1) ** 2
        return ((e**2).sum(1) + (book.eta - 1) * along).mean()

    assert loss(book.encode(x)) < loss(plain.encode(x))
