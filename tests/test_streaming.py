from pyspark.sql import functions as F

from siftlake.operators.history import HistoryStore
from siftlake.streaming import incremental

SCHEMA = "file_seq long, file_id string, row_idx long, cells array<string>, header array<string>"


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"1"\n\nbad"q\n')
    (tmp_path / "b.csv").write_text("y,2\n")
    drain(incremental.stream_lines(spark, str(tmp_path), "csv"), "lines")
    rows = spark.table("lines").orderBy("cells").collect()
    assert [(r.cells, r.error) for r in rows] == [(None, "quote within a field"), (["x", "1"], None), (["y", "2"], None)]


def test_ingest_is_idempotent_and_incremental(spark, tmp_path):
    header = ["email", "password"]
    make = lambda rows: spark.createDataFrame([(0, "f", i, c, header) for i, c in rows], SCHEMA)
    source = f"{tmp_path}/in"
    make([(0, ["a@x.org", "p"]), (1, ["b@x.org", "q"])]).coalesce(1).write.mode("append").parquet(source)
    store = HistoryStore(spark, f"{tmp_path}/db")
    run = lambda: incremental.ingest_stream(spark.readStream.schema(SCHEMA).parquet(source), store, "d", f"{tmp_path}/cp").awaitTermination()
    run()
    make([(2, ["a@x.org", "r"]), (3, ["a@x.org", "p"]), (4, ["c@x.org", "p"])]).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    got = {r.event_type: r["count"] for r in store.read("normalized_rows").groupBy("event_type").count().collect()}
    assert got == {
        "new_address": 3, "address_hash": 3, "credential_hash": 3, "addr_cred": 4, "known_address_new_credential": 1, "row": 4, "duplicate_row": 1,
    }


def test_replayed_batch_adds_nothing(spark, tmp_path):
    """The second try of a batch, after a failure between the write and the stream's commit, gives what the first gave."""
    header = ["email", "password"]
    make = lambda rows: spark.createDataFrame([(0, "f", i, c, header) for i, c in rows], SCHEMA)
    store = HistoryStore(spark, f"{tmp_path}/db")
    run = incremental.ingest_batch(store, "d/e f")
    run(make([(0, ["a@x.org", "p"]), (1, ["b@x.org", "q"])]), 0)
    second = make([(2, ["a@x.org", "p"]), (3, ["c@x.org", "q"]), (4, ["c@x.org", "q"])])
    run(second, 1)
    state = lambda: sorted((r.event_type, r.row_hash or "", r.address_hash or "", r.credential_hash or "", r.id) for r in store.read("normalized_rows").collect())
    once = state()
    run(second, 1)
    assert state() == once and sum(r[0] == "duplicate_row" for r in once) == 2
    run(make([(5, ["c@x.org", "q"])]), 2)
    assert sum(r[0] == "duplicate_row" for r in state()) == 3


def test_half_written_versions_are_not_read(spark, tmp_path):
    store = HistoryStore(spark, f"{tmp_path}/db")
    rows = spark.createDataFrame([("a", "B")], "canonical_hash string, breach_name string")
    assert store.insert("address_breaches", rows) == 1 and store.insert("address_breaches", rows) == 0
    spark.createDataFrame([("z", "B")], "canonical_hash string, breach_name string").write.parquet(f"{tmp_path}/db/address_breaches/v-half")
    (tmp_path / "db/address_breaches/v-half/_SUCCESS").unlink()
    assert [r.canonical_hash for r in store.read("address_breaches").collect()] == ["a"]


def test_windows_on_a_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", i % 3, "e", 1.0) for i in range(0, 300, 5)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e")
    drain(incremental.tumbling(stream, "1 hour"), "tumbling", "complete")
    batch = {(r.start, r.n) for r in incremental.tumbling(df, "1 hour").collect()}
    assert {(r.start, r.n) for r in spark.table("tumbling").collect()} == batch and len(batch) == 5
    assert incremental.sessions(df, "10 minutes").count() == len(rows)
    drain(incremental.first_seen_stream(stream, "user_id"), "first")
    assert spark.table("first").count() == 3
