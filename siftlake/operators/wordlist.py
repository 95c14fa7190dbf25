"""Weak-password tables: word lists, their digests, change detection, probes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.hashing import md5, ntlm, sha1, sha256, sha512
from siftlake.functions.text import trim

#: The built-in list of common weak passwords.
WEAK_PASSWORDS = [
    "password", "admin", "test", "123456", "12345", "123456789", "12345678", "1234567", "1234567890", "qwerty", "asdfgh",
    "letmein", "welcome", "monkey", "dragon", "master", "sunshine", "password123", "passw0rd", "123", "abc", "abc123",
    "xyz", "aaa", "111", "000", "1234", "pass", "user", "root", "abcd", "qwer", "zxcv", "abcde", "asdfg", "zxcvb",
    "aaaaa", "11111", "testpassword123",
]


def builtin_words(spark: SparkSession, custom: list[str] | None = None) -> DataFrame:
    """M-04: the built-in list and custom passwords as ``plaintext``.

    An Arrow table becomes a local relation, whose size Spark knows. A list of Python rows would be an RDD that counts as
    larger than any table, so that Spark broadcasts the cells that are probed instead of the words.
    """
    words = list(dict.fromkeys([*WEAK_PASSWORDS, *(custom or [])]))
    return spark.createDataFrame(pa.table({"plaintext": pa.array(words, pa.string())}))


def load_words(spark: SparkSession, path: str) -> DataFrame:
    """M-01: every ``*.txt`` below ``path``: trimmed lines without blanks and comments."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(path)
    return lines.select(trim(F.col("value")).alias("plaintext")).where("plaintext <> '' AND NOT startswith(plaintext, '#')").distinct()


def rainbow_table(words: DataFrame, with_ntlm: bool = True) -> DataFrame:
    """M-02: ``plaintext, md5, sha1, sha256, sha512, ntlm``."""
    w = F.col("plaintext")
    return words.select(
        w, md5(w).alias("md5"), sha1(w).alias("sha1"), sha256(w).alias("sha256"), sha512(w).alias("sha512"),
        (ntlm(w) if with_ntlm else F.lit(None).cast("string")).alias("ntlm"),
    )


def digests(table: DataFrame, kinds: tuple[str, ...] = ("md5", "sha256")) -> DataFrame:
    """``hash, plaintext`` in long form; ``kinds`` of all five is the strict probe (Q-21)."""
    each = F.explode(F.array(*kinds)).alias("hash")
    return table.select("plaintext", each).where("hash IS NOT NULL")


def weak_hash_probe(cells: DataFrame, column: str, hashes: DataFrame) -> DataFrame:
    """D-19, D-21: ``cells`` with the ``plaintext`` of a weak hash they hold, null elsewhere. Whether the list is broadcast is
    Spark's decision by its size."""
    return cells.join(hashes.select(F.col("hash").alias("__h"), "plaintext"), F.lower(column) == F.col("__h"), "left").drop("__h")


def weak_plaintext_probe(cells: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """D-20 (strict mode): cells that are weak passwords themselves."""
    return cells.join(words.select(F.col("plaintext").alias("__w")), F.col(column) == F.col("__w"), "left_semi")


def signatures(spark: SparkSession, path: str) -> DataFrame:
    """M-03: ``path, signature`` of each word list."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", F.md5("content").alias("signature"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """M-03: lists that are new, gone or different."""
    both = now.withColumnRenamed("signature", "s1").join(before.withColumnRenamed("signature", "s0"), "path", "full")
    return both.where(~F.col("s1").eqNullSafe(F.col("s0"))).select("path")


def weak_lookup(hash_: Column, table: dict[str, str]) -> Column:
    """D-21 for a handful of hashes: a literal map."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(hash_)) if pairs else F.lit(None).cast("string")
