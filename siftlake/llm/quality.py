"""Quality rules, native: per-document rules, then host-level verdicts from shrunk failure rates.

Every document gets its base figures in one narrow pass of built-in functions. Failures are added up by host
(``source``), each host's rate is shrunk by a beta prior fitted to all hosts (method of moments), and hosts whose shrunk
rate passes ``MAX_HOST_RATE`` are rejected with all their documents.

The spread of raw rates holds, besides that of the hosts, the chance of drawing few documents; the binomial part is
taken out before the prior's weight is read off, so that small hosts are not shrunk too little.

Defined results: a null or empty text has no words and fails; a document whose host is null or empty keeps its own
verdict; repeated rows are judged as often as they occur; texts are judged whole in one expression, whose arrays take
about 60 bytes a word for the time of the row; an empty table gives no rows; columns of other names are carried, never
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import BROADCAST_BYTES, let, materialize, memory_bytes

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A host is rejected when more than this share of its documents is expected to fail.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e4
SALTS = 32


def _repeat_words(words: Column) -> Column:
    """Words within windows of ``WINDOW`` words that are found twice or more in the text, by 64-bit window hashes."""

    def hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[h.getItem(i + j) for j in range(WINDOW)]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(w: Column) -> Column:
        marked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        twice = let(marked, lambda s: F.filter(s, lambda e, k: same(s, e, k + 1) | ((k > 0) & same(s, e, k - 1))))
        return let(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

    some = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), repeated(w)).otherwise(F.lit(0).cast("long"))
    found = let(let(F.transform(words, lambda x: F.xxhash64(x)), hashes), some)
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def _fails(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def base_failed(text: Column) -> Column:
    """Whether a text fails the base rules, without the figures that no rule needs."""
    return let(_words(text), lambda w: _fails(F.size(w).cast("long"), _repeat_words(w)))


def base_figures(text: Column) -> Column:
    """A struct of the base figures and ``base_failed`` of a text."""
    text = F.coalesce(text, F.lit(""))

    def figures(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = lambda q: _fails(q["n_words"], q["n_repeat_words"])
    return let(let(_words(text), figures), lambda q: F.struct(*[q[n].alias(n) for n in names], failed(q).alias("base_failed")))


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and weight (in documents) of the beta prior of ``hosts`` (``documents, failures``), by moments.

    With p the mean rate over n hosts of m documents each, raw rates vary by s**2 = p (1 - p) (1 + (mean 1/m) w) / (w + 1);
    solved for the weight w. Rates that vary no more than by chance shrink all the way to the mean, those that vary
    fully not at all.
    """
    rate = F.col("failures") / F.col("documents")
    fit = hosts.agg(
        F.sum("failures").alias("f"), F.sum("documents").alias("n"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("documents")).alias("few")
    ).first()
    mean = fit.f / fit.n if fit.n else 0.0
    most = mean * (1 - mean)
    if not fit.n or most == 0:
        return mean, MOST_WEIGHT
    between = fit.v - most * fit.few
    return mean, min(max((most - fit.v) / between, LEAST_WEIGHT), MOST_WEIGHT) if between > 0 else MOST_WEIGHT


def rejected_hosts(judged: DataFrame, host: str, failed: Column) -> DataFrame:
    """Hosts whose shrunk failure rate passes ``MAX_HOST_RATE``: ``host, documents, failures, rate``."""
    hosts = judged.where(F.col(host) != "").groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("documents"), F.sum(failed.cast("long")).alias("failures")
    )
    hosts = materialize(hosts, "hosts")
    mean, weight = prior(hosts)
    shrunk = (F.col("failures") + mean * weight) / (F.col("documents") + weight)
    return materialize(hosts.withColumn("rate", shrunk).where(F.col("rate") > MAX_HOST_RATE), "rejected-hosts")


def with_host_verdict(judged: DataFrame, host: str, hosts: DataFrame, salt: Column) -> DataFrame:
    """Adds ``__host_failed``. Rejected hosts are broadcast only when small; else both sides are salted."""
    bad = hosts.select(F.col("host").alias("__host"), F.lit(True).alias("__host_failed"))
    if memory_bytes(hosts) <= BROADCAST_BYTES:
        out = judged.join(F.broadcast(bad), F.col(host) == F.col("__host"), "left")
    else:
        bad = bad.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = judged.withColumn("__s", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
        out = judged.join(bad, (F.col(host) == F.col("__host")) & (F.col("__s") == F.col("__salt")), "left").drop("__s", "__salt")
    return out.withColumn("__host_failed", F.coalesce("__host_failed", F.lit(False))).drop("__host")


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, base figures, ``base_failed``, ``host_failed`` and ``kept`` of every document, without texts."""
    judged = docs.select("doc_id", F.col("source").alias("host"), base_figures(F.col("text")).alias("q"))
    judged = materialize(judged.select("doc_id", "host", "q.*"), "quality")
    hosts = rejected_hosts(judged, "host", F.col("base_failed"))
    out = with_host_verdict(judged, "host", hosts, F.col("doc_id")).drop("host").withColumnRenamed("__host_failed", "host_failed")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns.

    Texts are judged once and written with their verdict, those that fail without the text: reading them again costs far
    less than judging them twice, whose garbage also lets executors grow.
    """
    columns = docs.columns
    judged = docs.withColumn("__failed", base_failed(F.col("text")))
    judged = materialize(judged.withColumn("text", F.when(~F.col("__failed"), F.col("text"))), "quality-docs")
    hosts = rejected_hosts(judged, "source", F.col("__failed"))
    out = with_host_verdict(judged.where(~F.col("__failed")), "source", hosts, F.col("doc_id"))
    return out.where(~F.col("__host_failed")).select(*columns)
