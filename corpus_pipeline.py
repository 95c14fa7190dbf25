"""The corpus pipeline: quality rules, near-duplicates, repeated substrings, packing.

Each stage takes the documents its predecessor kept and returns documents (the last one: packed pieces). ``run`` writes
every stage as Parquet in the shared folder and reads it back, so that a lost executor costs one stage's tasks only; a
stage's table goes when its successor is written.

Defined results: null and empty texts fail the quality rules; documents without ``doc_id`` are judged by the quality rules
and packed, but neither are nor have near copies or repeats; rows that share a ``doc_id`` stay or go together as near
copies; repeated rows are equal near copies, of which one ``doc_id`` stays, with all its rows; an empty table gives no
pieces; further columns of documents are carried up to packing, whatever their names. Very long texts are held whole by one
worker at a time (the operators say how much each takes for a byte).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlake.llm import minhash, packing, quality, substring
from siftlake.llm.common import Tables, read_table
from siftlake.llm.queries import tokenizer_path
from siftlake.scratch import spread


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and come from hosts that pass."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.keep_one(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id holds."""
    return substring.remove_repeats(docs)


#: Chunks that packing keeps in a worker: half of those that `op1_packing` keeps, as executors are full when it runs.
KEPT_CHUNKS = 400_000


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 2048."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, size=2048, entries=KEPT_CHUNKS)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated substrings", repeated_substrings),
    ("packing", packed),
]

#: SQL cannot express the tokenizer or the near-duplicate stage; tests compare ``run`` with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    tables = Tables("pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = tables(stage(spark, docs, sf_dir), name)
        if k:
            tables.drop(STAGES[k - 1][0])
    return docs
