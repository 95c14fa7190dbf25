import hashlib
import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake import cli, config
from siftlake.operators import alias, anomaly, custody, enrich, history, report, risk, similar, sync, wordlist
from siftlake.operators.history import HistoryStore


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def score(spark, wp=False, wh=False, br=0, nc=False, types=(), an=0):
    arr = F.array(*map(F.lit, types)) if types else F.array().cast("array<string>")
    return one(spark, risk.risk_score(F.lit(wp), F.lit(wh), F.lit(br), F.lit(nc), arr, F.lit(an)))


def test_risk(spark):
    assert score(spark).score == 0 and score(spark).explanation == "No significant risk factors detected"
    top = score(spark, True, True, 300, True, ["ssn", "credit_card", "national_id"], 500)
    assert (top.score, top.level, top.breach, top.pii, top.anomaly) == (27, "orange", 40, 25, 8)
    assert score(spark, br=1, nc=True).breach == 30 and score(spark, nc=True).breach == 0
    assert score(spark, True).score == 7


def test_entropy(spark):
    assert one(spark, anomaly.entropy(F.lit(""))) == 0.0
    assert one(spark, anomaly.entropy(F.lit("abcd"))) == pytest.approx(2.0)
    p = 1 / 2
    assert one(spark, anomaly.entropy(F.lit("é"))) == pytest.approx(-p * math.log2(p))


def test_password_anomaly(spark):
    kind = lambda v: (lambda a: a and a.kind)(one(spark, anomaly.password_anomaly(F.lit(v))))
    assert [kind(v) for v in ("", "x" * 257, "abc", "abc1", "a" * 20)] == ["unusual_format", "unusual_format", "uniform_distribution", None, None]


def test_alias_links(spark):
    df = spark.createDataFrame([("a.b@x.org",), ("ab@x.org",), ("AB@X.org",), (None,), ("c@x.org",)], "value string")
    assert [(r.canonical, r.variant) for r in alias.alias_links(df, "email_dot").collect()] == [("a.b@x.org", "ab@x.org")]
    left = spark.createDataFrame([("+1 555",)], "value string")
    right = spark.createDataFrame([("1-555",), ("+1 555",)], "value string")
    pairs = alias.alias_pairs(left, right, "phone_normalization")
    assert [(r.canonical, r.variant) for r in pairs.collect()] == [("+1 555", "1-555")]
    assert one(spark, alias.email_plus_alias(F.lit("A+t@x.org"))).canonical == "a@x.org"
    assert one(spark, alias.email_plus_alias(F.lit("plain"))) is None


def test_store(spark, tmp_path):
    store = history.HistoryStore(spark, f"{tmp_path}/db")
    assert store.read("address_alternates").count() == 0
    rows = spark.createDataFrame([("a", "b", "x"), ("a", "b", "y"), ("a", "c", "z")], "canonical_hash string, alternate_hash string, alternate_form string")
    assert store.insert("address_alternates", rows) == 2 and store.insert("address_alternates", rows) == 0
    store.export(f"{tmp_path}/out")
    other = history.HistoryStore(spark, f"{tmp_path}/db2")
    assert other.import_(f"{tmp_path}/out")["address_alternates"] == {"imported": 2, "skipped": 0}
    assert other.import_(f"{tmp_path}/out")["address_alternates"] == {"imported": 0, "skipped": 2}
    stats = store.stats().first()
    assert stats.total_variants == 2 and stats.avg_variants_per_address == 0.0 and stats.top_breach is None


def test_cooccurrence_of_large_groups_stays_connected(spark):
    df = spark.createDataFrame([(1, f"n{i}") for i in range(6)] + [(2, "n0"), (2, "n1")], "g int, address_hash string")
    edges = history.cooccurrence(df, ["g"], most=4).collect()
    assert len(edges) == 5 and sum(e.cooccurrence_count for e in edges) == 6


def test_cooccurrence_counts_all_pairs_of_large_groups(spark):
    nodes = [f"n{i:03}" for i in range(600)]
    df = spark.createDataFrame([(1, n) for n in nodes] + [(2, n) for n in nodes[:201]] + [(3, "n000"), (3, "n000"), (3, None), (None, "n001")], "g int, address_hash string")
    edges = {(e.canonical_hash_1, e.canonical_hash_2): e.cooccurrence_count for e in history.cooccurrence(df, ["g"]).collect()}
    assert edges == {(a, b): 1 + (b < "n201") for i, a in enumerate(nodes) for b in nodes[i + 1 :]}


def test_similar(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = similar.find_similar(df, df, 0.85, 5, blocks=2).orderBy("query_id").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 2), (2, 1)]
    assert one(spark, similar.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_duplicates_among_known_rows(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [0.1, 1.0]), (4, None, [0.0, -1.0]), (5, "a", None), (6, None, None)]
    df = spark.createDataFrame(rows, "id long, address_hash string, embedding array<float>")
    got = similar.find_duplicates(df, df).collect()
    assert sorted(map(tuple, got)) == [(1, 2, "hash"), (2, 1, "hash"), (3, 2, "similar"), (5, 1, "hash")]


def test_wordlists(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# no\n\n secret \nadmin\n")
    before = wordlist.signatures(spark, str(tmp_path)).collect()
    assert sorted(r.plaintext for r in wordlist.load_words(spark, str(tmp_path)).collect()) == ["admin", "secret"]
    (tmp_path / "w.txt").write_text("other\n")
    old = spark.createDataFrame(before, "path string, signature string")
    assert wordlist.changed(wordlist.signatures(spark, str(tmp_path)), old).count() == 1
    table = wordlist.rainbow_table(wordlist.builtin_words(spark, ["hunter2"]))
    row = table.where("plaintext = 'hunter2'").first()
    assert row.ntlm == wordlist.ntlm.func.__globals__["ntlm_text"]("hunter2") and len(row.sha512) == 128
    cells = spark.createDataFrame([("5F4DCC3B5AA765D61D8327DEB882CF99",), ("x",)], "value string")
    assert [r.plaintext for r in wordlist.weak_hash_probe(cells, "value", wordlist.digests(table)).orderBy("value").collect()] == ["password", None]


def test_custody(spark):
    signer = custody.Signer(spark)
    record = signer.sign(custody.CustodyRecord("r", "f", "file_ingested", "op", "h", 1, 2, "2024-01-01T00:00:00Z"))
    custody.verify_record(spark, record)
    with pytest.raises(custody.TamperError):
        custody.verify_record(spark, custody.CustodyRecord(**{**record.__dict__, "file_size": 9}))


def test_files(tmp_path):
    f = tmp_path / "x"
    f.write_bytes(b"abc")
    with custody.file_lock(f), pytest.raises(FileExistsError), custody.file_lock(f):
        pass
    with custody.working_copy(f, tmp_path / "w") as copy:
        assert custody.file_digest(copy) == custody.file_digest(f)
    assert not copy.exists()
    custody.secure_delete(f)
    assert not f.exists()


def test_sync(spark):
    names = spark.createDataFrame([(f"n{i}",) for i in range(500)], "a string")
    data = sync.bloom_filter(names, "a", 500)
    assert all(sync.might_contain(spark, data, f"n{i}") for i in range(0, 500, 25))
    assert sum(sync.might_contain(spark, data, f"other{i}") for i in range(200)) < 30
    peers = spark.createDataFrame([("a", 100.0), ("a", 190.0), ("b", 10.0)], "peer_id string, last_seen double")
    assert [r.peer_id for r in sync.live_peers(peers, 200.0).collect()] == ["a"]


def test_jobs():
    queue = sync.JobQueue()
    first, second = queue.enqueue("a"), queue.enqueue("b")
    assert queue.claim() is first and queue.claim() is second and queue.claim() is None
    queue.move(first.job_id, sync.JobState.COMPLETED, rows_processed=3)
    with pytest.raises(ValueError):
        queue.move(first.job_id, sync.JobState.CANCELLED)


def test_enrich(spark):
    pairs = spark.createDataFrame([("a", "2024-03-05 00:00:00"), ("a", "2024-03-02 00:00:00")], "address_hash string, t string").selectExpr("address_hash", "CAST(t AS TIMESTAMP) AS first_seen_at")
    breaches = spark.createDataFrame([("a", "B", 5, "2024-03-01")], "canonical_hash string, breach_name string, pwn_count long, d string").withColumn("breach_date", F.to_date("d"))
    assert enrich.new_credential_since_breach(pairs, breaches).count() == 1
    assert enrich.breach_summary(pairs, breaches).first().breach_count == 1
    assert enrich.apply_plugins(pairs, [lambda df: df.withColumn("x", F.lit(1))]).columns[-1] == "x"


def test_formats():
    summary = {"rows_processed": 2, "unique_addresses": 1, "pii": {"emails": 1, "ssn": 0}, "errors": ["bad"]}
    assert json.loads(report.format_json(summary))["rows_processed"] == 2
    assert report.format_csv(summary).splitlines()[:3] == ["metric,value", "rows_processed,2", "unique_addresses,1"]
    assert "ssn" not in report.format_text(summary) and "emails: 1" in report.format_text(summary)
    assert [json.loads(x)["event"] for x in report.format_jsonl(summary).splitlines()] == ["summary", "metadata", "error"]


def test_config(tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"email_suffix_substitutions": {"x.org": ["bad domain"]}}))
    with pytest.raises(config.ConfigError):
        config.load(str(f))
    f.write_text(json.dumps({"custom_passwords": ["hunter2"]}))
    assert config.load(str(f)).custom_passwords == ["hunter2"]
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "none.json"))


def test_findings_stream_into_json():
    findings = [{"row_number": 1, "findings": [{"type": "email", "column": 0}]}, {"row_number": 2, "findings": []}]
    text = "".join(report.FORMATTERS["json"]({"a": 1}, iter(findings)))
    assert json.loads(text) == {"a": 1, "detailed_findings": findings}
    assert json.loads(report.format_json({"a": 1}, [])) == {"a": 1}


def test_enriched_ingest(spark, tmp_path):
    header = ["email", "password"]
    schema = "file_seq long, file_id string, row_idx long, cells array<string>, header array<string>"
    rows = lambda *cells: spark.createDataFrame([(0, "f", i, [*c], header) for i, c in enumerate(cells)], schema)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    vectors = spark.createDataFrame([(sha(f"{c}@x"), v) for c, v in (("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]))], "address_hash string, embedding array<float>")
    breaches = spark.createDataFrame([(sha("b@x"), "B", 5), (sha("z@x"), "B", 5)], "canonical_hash string, breach_name string, pwn_count long")
    store = HistoryStore(spark, f"{tmp_path}/db")
    every = enrich.Enrichment(embeddings=True, breaches=True)
    enrich.ingest_enriched(store, rows(("a@x", "p"), ("c@x", "p")), "one", every, vectors, breaches)
    out = enrich.ingest_enriched(store, rows(("b@x", "p"), ("a@x", "q"), ("n@x", "q")), "two", every, vectors, breaches)
    assert [(r.query_id, r.id) for r in out["similar"].collect()] == [(sha("b@x"), sha("a@x"))]
    assert {r.address_hash: r.breach_count for r in out["breached"].collect()} == {sha("b@x"): 1, sha("n@x"): 0}
    assert store.read("canonical_addresses").count() == 4 and store.read("address_breaches").count() == 1
    assert set(enrich.ingest_enriched(store, rows(("q@x", "p")), "three")) == {"events"}


def test_similar_is_exact_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 8))
    x[10] = x[20]
    odd = [(500, [0.0] * 8), (501, None), (502, [float("nan")] * 8), (503, [1.0] * 3), (504, [])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 12)
    np.fill_diagonal(s, -2)
    want = {(q, int(j)) for q in range(0, 150, 5) for j in np.lexsort((np.arange(150), -s[q]))[:4] if s[q, j] >= 0.3}
    for blocks in (None, 3):
        got = similar.find_similar(df, df.where("id % 5 = 0"), 0.3, 4, blocks).collect()
        assert {(r.query_id, r.id) for r in got} == want


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "d.csv").write_text("email,password\njohn@example.com,5f4dcc3b5aa765d61d8327deb882cf99\n")
    (tmp_path / "e.yaml").write_text("a: 1")
    assert cli.main(["ingest", f"{tmp_path}/d.csv", f"{tmp_path}/e.yaml", "--database", f"{tmp_path}/db"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert (out["rows_processed"], out["unique_addresses"], out["hashed_credentials"], out["pii"]["emails"]) == (2, 1, 1, 1)
    assert len(out["errors"]) == 1 and "unsupported format" in out["errors"][0] and len(out["detailed_findings"]) == 1
    assert cli.main(["stats", "--database", f"{tmp_path}/db"]) == 0
    assert json.loads(capsys.readouterr().out)["total_rows"] == 5
    assert cli.main(["status", "--database", f"{tmp_path}/db"]) == 0
    job = json.loads(capsys.readouterr().out)
    assert (job["kind"], job["state"], job["events"]) == ("ingest", "completed", 5)
    assert cli.main(["status", job["job_id"], "--database", f"{tmp_path}/db"]) == 0
    assert json.loads(capsys.readouterr().out) == job
    assert cli.main(["ingest", f"{tmp_path}/d.csv", "--findings", f"{tmp_path}/found", "--output", f"{tmp_path}/out.json"]) == 0
    assert "detailed_findings" not in json.loads((tmp_path / "out.json").read_text())
    assert spark.read.json(f"{tmp_path}/found").first().row_number == 1
    with pytest.raises(RuntimeError), sync.JobLog(spark, f"{tmp_path}/db/jobs").running("x"):
        raise RuntimeError("no")
    assert sync.JobLog(spark, f"{tmp_path}/db/jobs").latest()[0]["state"] == "failed"


def test_probes_broadcast_the_words_and_not_the_cells(spark):
    words = wordlist.builtin_words(spark, ["hunter2", "admin"])
    assert words.columns == ["plaintext"] and [r.plaintext for r in words.collect()] == [*wordlist.WEAK_PASSWORDS, "hunter2"]
    cells = spark.range(100_000).selectExpr("id", "md5(CAST(id AS STRING)) AS value")
    hashes = wordlist.digests(wordlist.rainbow_table(words, with_ntlm=False))
    found = wordlist.weak_hash_probe(cells, "value", hashes).where("plaintext IS NOT NULL")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert {r.plaintext for r in found.collect()} == {"111", "123", "1234", "11111", "12345"}
    plan = wordlist.weak_plaintext_probe(cells, "value", words)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi, BuildRight" in plan


def broadcasts_no_cells(spark, sf, name):
    """The rows of a query and its SQL agree, and no table is the left side that a join broadcasts."""
    from siftlake.plans import registry

    customers = spark.range(20_000).selectExpr(
        "id AS c_custkey", "CASE WHEN id % 7 <> 3 THEN 'Customer#' || id END AS c_name", "'S' || id % 5 AS c_mktsegment")
    customers.coalesce(1).write.parquet(f"{sf}/customer.parquet")

    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}

    before = executions()
    df = registry.all_queries()[name](spark, sf)
    ours = sorted(df.collect())
    plans = "".join(plan for i, plan in executions().items() if i not in before)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{sf}/customer.parquet/*.parquet'")
    assert ours == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.all_sql()[name]})").fetchall())
    assert "BuildRight" in plans and "BuildLeft" not in plans


def test_ingest_summary_broadcasts_no_cells(spark, tmp_path):
    broadcasts_no_cells(spark, str(tmp_path), "s01_ingest_summary")


def test_formats_broadcast_no_cells(spark, tmp_path):
    broadcasts_no_cells(spark, str(tmp_path), "s04_s07_formats")


def test_formats_broadcast_no_more_rows_than_the_words_have(spark, tmp_path):
    """However many customers there are, the driver holds the words with their digests and single counts."""
    from siftlake.plans import registry

    customers = spark.range(20_000).selectExpr("id AS c_custkey", "'Customer#' || id AS c_name", "'S' || id % 5 AS c_mktsegment")
    customers.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.executionsList()
        return {found.apply(i).executionId() for i in range(found.size())}

    before, sent = executions(), []
    registry.all_queries()["s04_s07_formats"](spark, str(tmp_path))
    for k in executions() - before:
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if node.name() == "BroadcastExchange":
                rows = [m.accumulatorId() for m in map(node.metrics().apply, range(node.metrics().size())) if m.name() == "number of output rows"]
                sent += [int(values.apply(x).replace(",", "")) for x in rows if values.contains(x)]
    assert max(sent) == 2 * len(wordlist.WEAK_PASSWORDS)
