"""Anomalies: entropy and length outliers, rare domains, unusual passwords, unseen combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.scratch import written

#: The kinds of anomaly.
KINDS = [
    "entropy_outlier", "rare_domain", "unusual_format", "unseen_combination", "length_outlier", "uniform_distribution",
    "baseline_deviation",
]


#: Different characters up to which each is counted by a pass of its own; beyond, the characters are sorted.
FEW_CHARACTERS = 200


def _once(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def entropy(x: Column) -> Column:
    """E-01: Shannon entropy of the characters, with the byte length as the denominator.

    A text of few different characters is counted by one quick pass for each, one of many by sorting its characters.
    """
    size = F.octet_length(x)
    term = lambda n: _once(n / size, lambda s: -s * F.log2(s))

    def passes(distinct: Column) -> Column:
        count = lambda c, n: n - F.length(F.replace(x, c, F.lit("")))
        return _once(F.length(x), lambda n: F.transform(F.array_sort(distinct), lambda c: term(count(c, n))))

    def runs(chars: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(chars, i) != F.get(chars, i - 1))
        starts = F.filter(F.sequence(F.lit(0), F.size(chars) - 1), first)
        return _once(starts, lambda at: F.transform(at, lambda p, k: term(F.coalesce(F.get(at, k + 1), F.size(chars)) - p)))

    terms = _once(
        F.split(x, ""),
        lambda chars: _once(F.array_distinct(chars), lambda d: F.when(F.size(d) <= FEW_CHARACTERS, passes(d)).otherwise(_once(F.array_sort(chars), runs))),
    )
    return F.when(size > 0, F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)).otherwise(F.lit(0.0))


def email_domain(x: Column) -> Column:
    """The lower-cased text after the first ``@``; null without one."""
    return F.when(x.contains("@"), F.lower(F.regexp_extract(x, "(?s)^[^@]*@(.*)$", 1)))


def baseline(values: DataFrame, column: str = "value") -> DataFrame:
    """E-02: one row of ``mean_entropy, sd_entropy, mean_length, sd_length, n``; none of an empty table."""
    return _baseline(values.select(entropy(F.col(column)).alias("__e"), F.octet_length(column).alias("__n")))


def _baseline(measured: DataFrame) -> DataFrame:
    out = measured.agg(
        F.avg("__e").alias("mean_entropy"), F.stddev_pop("__e").alias("sd_entropy"), F.avg("__n").alias("mean_length"),
        F.stddev_pop("__n").alias("sd_length"), F.count("__n").alias("n"),
    )
    return out.where("n > 0")


def top_domains(values: DataFrame, column: str = "value", k: int = 10) -> DataFrame:
    """E-02: the ``k`` most frequent domains, ties by name."""
    d = values.select(email_domain(F.col(column)).alias("domain")).where("domain IS NOT NULL")
    return d.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(k)


def outliers(values: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """E-03 and E-04: ``values`` (or their columns ``keep``) with ``entropy_risk, length_risk`` (null: none) against their
    own baseline.

    Entropies are computed once and written with the kept columns; name those, so that long values are not written. The
    baseline is one row of five numbers; it reaches the scan as one scalar subquery.
    """
    names = ["mean_entropy", "sd_entropy", "mean_length", "sd_length"]
    measured = values.select(*(keep or values.columns), entropy(F.col(column)).alias("__e"), F.octet_length(column).alias("__n"))
    measured = written(measured, "entropies")
    e, n, b = F.col("__e"), F.col("__n"), F.col("__b")
    out = measured.withColumn("__b", _baseline(measured).select(F.struct(*names)).scalar())
    far = F.abs(e - b["mean_entropy"]) / F.greatest(b["sd_entropy"], F.lit(0.1)) > 3
    high = e > b["mean_entropy"] + 3 * b["sd_entropy"]
    long_ = F.abs(n - b["mean_length"]) / b["sd_length"] > 3
    out = out.withColumns({
        "entropy_risk": F.when(far, F.when(high, 85).otherwise(75)),
        "length_risk": F.when((b["sd_length"] >= 0.1) & long_, F.when(n > b["mean_length"], 70).otherwise(60)),
    })
    return out.drop("__e", "__n", "__b")


def rare_domains(values: DataFrame, column: str = "value") -> DataFrame:
    """E-05: ``domain, n, frequency, risk`` of domains that hold less than a hundredth of the addresses."""
    d = values.select(email_domain(F.col(column)).alias("domain")).where("domain IS NOT NULL")
    counts = d.groupBy("domain").agg(F.count("*").alias("n"))
    f = F.col("n") / d.agg(F.count("*").alias("t")).scalar()
    return counts.withColumn("frequency", f).where("frequency < 0.01").withColumn("risk", F.floor(100 * (1 - F.col("frequency"))).cast("int"))


def password_anomaly(x: Column) -> Column:
    """E-06: ``struct<kind, risk, metric, threshold>`` or null."""
    size = F.octet_length(x)
    variety = sum((x.rlike(p).cast("int") for p in ("[A-Z]", "[a-z]", "[0-9]", r"[^\p{IsAlphabetic}\p{N}]")), F.lit(0))
    made = lambda kind, risk, metric, most: F.struct(
        F.lit(kind).alias("kind"), F.lit(risk).alias("risk"), metric.cast("double").alias("metric"), F.lit(float(most)).alias("threshold")
    )
    return F.when((size == 0) | (size > 256), made("unusual_format", 90, size, 128)).when(
        (variety <= 1) & (size < 20), made("uniform_distribution", 60, variety, 2)
    )


def unseen_combinations(rows: DataFrame, fields: list[str], seen: DataFrame | None = None) -> DataFrame:
    """E-07: distinct combinations of ``fields`` that ``seen`` (``combination``) lacks, with risk 40."""
    combined = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    out = rows.select(combined.alias("combination")).distinct()
    out = out if seen is None else out.join(seen, "combination", "left_anti")
    return out.withColumn("risk", F.lit(40))
