"""What Python workers hold: Spark gives one worker to the tasks of all stages, beside an executor's full heap."""

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest

from siftlake.llm import minhash, packing, substring, tokens

WORD = public_tokenizers.path("word_bpe_49k.json")


class Docs:
    """Stands for a table: gives back the function that a worker would run."""

    def select(self, *columns):
        return self

    where = select

    def mapInArrow(self, run, schema):
        return run


def batch(texts: list[str]) -> pa.RecordBatch:
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, pa.array(texts, pa.string())], ["doc_id", "th", "text"])


def rows(run, data: pa.RecordBatch) -> list[dict]:
    return [r for b in run(iter([data])) for r in b.to_pylist()]


def words(n: int, seed: int = 1) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(50_000)}" for _ in range(n))


@pytest.mark.parametrize("stage", [minhash.sign, minhash.shingle_sets, substring.scan])
def test_other_stages_drop_the_tokenizer(spark, stage):
    data = batch([words(100, k) for k in range(5)])
    tokens._encoders.clear()
    rows(packing.cut_pieces(Docs(), WORD, 1, 2048), data)
    assert list(tokens._encoders) == [WORD]
    assert len(rows(packing.cut_pieces(Docs(), WORD, 1, 2048), data)) == 5 and tokens._encoders  # its own tasks keep it
    assert len(rows(stage(Docs()), data)) == 5
    assert not tokens._encoders


@pytest.mark.parametrize("stage", [minhash.sign, substring.scan])
def test_memory_of_a_worker_stays_low(spark, stage):
    data = batch([words(500, k) for k in range(800)])  # 2.6 MB
    run = stage(Docs())
    rows(run, data.slice(0, 10))
    tracemalloc.start()
    try:
        for _ in run(iter([data])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24e6, peak


def test_fewer_kept_chunks_give_the_same_pieces(spark):
    data = batch([words(300, k % 3) for k in range(6)])
    few, many = (rows(packing.cut_pieces(Docs(), WORD, 1, 64, entries=n), data) for n in (8, 800_000))
    assert few == many and len(few) > 6


def test_packing_takes_no_python_rows(spark, tmp_path):
    spark.createDataFrame([(k, words(30, k)) for k in range(20)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    plan = packing.pack(spark.read.parquet(str(tmp_path / "d")), WORD, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan
