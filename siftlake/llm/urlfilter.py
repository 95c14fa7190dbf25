"""URL filters, native: a blocked Bloom filter of the listed URLs, then an exact hash join.

Listed entries are a host and a path prefix with an action. For each URL the suffixes of its host and the prefixes of its
path (of the lengths that occur in the list) are looked up in the filter: blocks of eight 64-bit words, one bit in each.
What passes meets the list in a hash join, which removes false positives; the longest entry decides.

The filter holds 16 bits an entry, at most ``MAX_BLOCKS`` blocks; a longer list lets more false positives through to the
join, never fewer hits.

Defined results: a null URL or one without ``://`` has empty host and path and gets the default; repeated rows are judged
as often as they occur; of two equal entries the blocking one wins; hosts of entries count in lower case, a null host is
no entry and a null path an empty one; an empty list gives every URL the default, an empty table no rows; columns of
``pages`` named ``host``, ``path``, ``rule`` or ``verdict`` give way to the results, others are carried. Very long URLs
are judged whole; at most (labels in the list) x (different lengths of its paths) keys are looked up for one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import BROADCAST_BYTES, let, materialize, memory_bytes

WORDS = 8
BITS_PER_ENTRY = 16
#: Largest filter: 2**18 blocks of 64 bytes, 16 MB in every task (8 million entries at full strength).
MAX_BLOCKS = 1 << 18
SALTS = 32
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column, word: int) -> Column:
    bit = F.shiftrightunsigned(F.xxhash64(F.lit("bits"), key), 6 * word).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom_words(keys: DataFrame, blocks: int) -> DataFrame:
    """One row: the filter as ``array<long>`` of ``WORDS * blocks`` words. ``keys`` has a column ``key``."""
    spark = keys.sparkSession
    bits = F.posexplode(F.array(*[_mask(F.col("key"), j) for j in range(WORDS)])).alias("j", "mask")
    at = keys.select(_block(F.col("key"), blocks).alias("block"), bits)
    at = at.groupBy((F.col("block") * WORDS + F.col("j")).cast("long").alias("id")).agg(F.bit_or("mask").alias("mask"))
    all_ = spark.range(WORDS * blocks).join(at, "id", "left")
    word = F.struct("id", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    return all_.agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["mask"]).alias("words"))


def in_bloom(words: Column, key: Column, blocks: int) -> Column:
    """Whether all bits of ``key`` are set in its block of the filter ``words``."""
    missing = F.lit(0).cast("long")
    block = F.slice(words, _block(key, blocks) * WORDS + 1, F.lit(WORDS))
    for j in range(WORDS):
        mask = _mask(key, j)
        missing = missing.bitwiseOR(block.getItem(j).bitwiseAND(mask).bitwiseXOR(mask))
    return missing == 0


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``. ``rules``: ``host, path, action`` (``allow`` or ``block``)."""
    fields = F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action"
    listed = rules.where(F.col("host").isNotNull()).select(*fields).groupBy("host", "path").agg(F.max("action").alias("action"))
    listed = materialize(listed.withColumn("key", F.concat("host", "path")), "url-rules")
    shape = listed.agg(
        F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),  # distinct lengths of paths only
    ).first()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * WORDS * 64 < shape.n * BITS_PER_ENTRY:
        blocks *= 2
    words = bloom_words(listed, blocks).scalar()

    # URLs are judged once for each different host and path; the pages meet their verdict by that pair.
    own = pages.withColumns({"__host": url_host(F.col(url)), "__path": url_path(F.col(url))})
    asked = own.select("__host", "__path").distinct()
    most = shape.labels or 1
    labels = F.split("__host", r"\.")
    tail = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - most + 1), F.lit(most))
    suffixes = lambda t: F.transform(F.sequence(F.lit(1), F.size(t)), lambda i: F.array_join(F.slice(t, i, F.size(t)), "."))
    lengths = F.array(*[F.lit(n) for n in sorted(shape.lengths)]).cast("array<int>")
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("__path")), lambda n: F.substring(F.col("__path"), F.lit(1), n)
    )
    keys = let(let(tail, suffixes), lambda ss: F.flatten(F.transform(ss, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))
    asked = asked.select("__host", "__path", F.explode(F.array_distinct(keys)).alias("__key"))
    asked = asked.where(in_bloom(words, F.col("__key"), blocks))

    entry = listed.select("key", F.struct(F.length("key").alias("size"), F.length("host").alias("host"), "action", F.col("key").alias("rule")).alias("__hit"))
    if memory_bytes(listed) <= BROADCAST_BYTES:
        found = asked.join(F.broadcast(entry), F.col("__key") == F.col("key"))
    else:
        entry = entry.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        asked = asked.withColumn("__salt", F.pmod(F.xxhash64("__host", "__path"), F.lit(SALTS)).cast("int"))
        found = asked.join(entry.hint("shuffle_hash"), (F.col("__key") == F.col("key")) & (F.col("__salt") == F.col("__s")))
    hits = found.groupBy("__host", "__path").agg(F.max("__hit").alias("__hit"))
    # Written, so that the join is dealt by an exchange of its own, which AQE may split at a hot URL.
    hits = materialize(hits, "url-hits")
    best = own.join(hits, ["__host", "__path"], "left")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    verdict = F.coalesce(F.col("__hit.action"), F.lit(default))
    return best.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__hit.rule").alias("rule"), verdict.alias("verdict"))
