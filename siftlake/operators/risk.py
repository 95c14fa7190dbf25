"""Risk scores of addresses from their findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of each type of finding; others count 1.
PII_WEIGHTS = {"ssn": 10, "credit_card": 10, "national_id": 5, "phone_number": 3, "ip_address": 3, "ipv4": 3, "ipv6": 3}
#: The sum of weights and caps by which scores are scaled.
SCALE = 123.0
#: The phrases of explanations; ``{}`` takes a count.
PHRASES = {
    "weak_password": "Uses weak/common password",
    "weak_hash": "Hash algorithm is weak (MD5/SHA1/SHA256)",
    "breach": "Found in {} breach(es)",
    "new_credential": "⚠️ NEW CREDENTIAL SINCE BREACH - Active exploitation risk",
    "pii": "Contains {} PII field(s)",
    "anomaly": "{} anomalies detected",
    "none": "No significant risk factors detected",
}
#: The highest score of each level.
LEVELS = [(10, "green"), (25, "yellow"), (50, "orange"), (75, "red")]


@dataclass(frozen=True)
class Weights:
    """R-05."""

    weak_password: float = 0.30
    weak_hash: float = 0.20
    breach: float = 0.40
    pii: float = 0.15
    anomaly: float = 0.10


def pii_score(types: Column) -> Column:
    """R-02, at most 25."""
    weight = F.create_map(*[F.lit(v) for kv in PII_WEIGHTS.items() for v in kv])
    total = F.aggregate(F.coalesce(types, F.array().cast("array<string>")), F.lit(0), lambda a, t: a + F.coalesce(F.try_element_at(weight, t), F.lit(1)))
    return F.least(total, F.lit(25))


def risk_score(weak_password: Column, weak_hash: Column, breaches: Column, new_credential: Column, types: Column,
               anomalies: Column, weights: Weights | None = None) -> Column:
    """R-01 to R-04: ``struct<score, level, weak_password, weak_hash, breach, pii, anomaly, explanation>``.

    Single precision as the rule asks; counts saturate instead of wrapping.
    """
    w = weights or Weights()
    password, hashed = F.when(weak_password, 30).otherwise(0), F.when(weak_hash, 20).otherwise(0)
    bonus = F.when(new_credential & (breaches > 0), 20).otherwise(0)
    breach = F.least(F.least(breaches, F.lit(4)) * 10 + bonus, F.lit(40)).cast("int")
    pii, anomaly = pii_score(types), F.least(anomalies, F.lit(8)).cast("int")
    single = lambda x: F.lit(x).cast("float")
    raw = sum(
        (f.cast("float") * single(k) for f, k in ((hashed, w.weak_hash), (breach, w.breach), (pii, w.pii), (anomaly, w.anomaly))),
        password.cast("float") * single(w.weak_password),
    )
    score = F.floor(((raw / single(SCALE)).cast("float") * single(100.0)).cast("float")).cast("int")
    count = F.size(types)
    said = [
        (weak_password, "weak_password", None), (weak_hash, "weak_hash", None), (breaches > 0, "breach", breaches),
        ((breaches > 0) & new_credential, "new_credential", None), (count > 0, "pii", count), (anomalies > 0, "anomaly", anomalies),
    ]
    explained = F.concat_ws("; ", *[F.when(hit, _phrase(name, n)) for hit, name, n in said])
    explained = F.when(explained == "", PHRASES["none"]).otherwise(explained)
    return F.struct(
        score.alias("score"), risk_level(score).alias("level"), password.alias("weak_password"), hashed.alias("weak_hash"),
        breach.alias("breach"), pii.alias("pii"), anomaly.alias("anomaly"), explained.alias("explanation"),
    )


def _phrase(name: str, count: Column | None) -> Column:
    before, _, after = PHRASES[name].partition("{}")
    return F.lit(before) if count is None else F.concat(F.lit(before), count.cast("string"), F.lit(after))


def risk_distribution(scores: DataFrame, column: str = "level") -> DataFrame:
    """How many rows each level holds, for reports."""
    return scores.groupBy(column).agg(F.count("*").alias("n"))


def risk_level(score: Column) -> Column:
    out = F.lit("critical")
    for most, name in reversed(LEVELS):
        out = F.when(score <= most, name).otherwise(out)
    return out
