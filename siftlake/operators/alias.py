"""Alias links between spellings of one identity: projections, and equi joins on a canonical key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.text import digits, suffix_map

#: The kinds of alias.
KINDS = [
    "email_plus", "email_dot", "email_domain", "phone_normalization", "national_id_variant", "user_id_variant",
    "username_case", "string_variant",
]


def _link(canonical: Column, variant: Column, kind: str, confidence: int) -> Column:
    return F.struct(canonical.alias("canonical"), variant.alias("variant"), F.lit(kind).alias("alias_type"), F.lit(confidence).alias("confidence"))


def email_plus_alias(x: Column) -> Column:
    """L-01: a link from the address without its ``+`` tag, or null."""
    v = F.lower(x)
    local, domain = F.regexp_extract(v, "(?s)^([^@]*)@(.*)$", 1), F.regexp_extract(v, "(?s)^([^@]*)@(.*)$", 2)
    base = F.concat(F.regexp_replace(local, "(?s)\\+.*$", ""), F.lit("@"), domain)
    return F.when(v.contains("@") & local.contains("+"), _link(base, v, "email_plus", 95))


def find_email_aliases(values: DataFrame, column: str = "value") -> DataFrame:
    """L-07: the links of all values that are addresses with a tag: ``canonical, variant, alias_type, confidence``."""
    links = values.select(email_plus_alias(F.col(column)).alias("a")).where("a IS NOT NULL")
    return links.select("a.*").distinct()


def email_domain_alias(x: Column, rules: dict[str, list[str]] | None = None) -> Column:
    """L-09: a link from the address at the canonical domain, or null."""
    v = F.lower(x)
    canonical = F.try_element_at(suffix_map(rules), F.regexp_extract(v, "@([^@]*)$", 1))
    return F.when(canonical.isNotNull(), _link(F.concat(F.regexp_extract(v, "(?s)^(.*)@[^@]*$", 1), F.lit("@"), canonical), v, "email_domain", 90))


def dot_key(x: Column) -> Column:
    v = F.lower(x)
    return F.when(v.contains("@"), F.concat(F.regexp_replace(F.regexp_extract(v, "(?s)^([^@]*)@", 1), "\\.", ""), F.lit("@"), F.regexp_extract(v, "(?s)^[^@]*@(.*)$", 1)))


#: Alias kind to (key of equal identities, form of the canonical text, confidence); keys may be null: no link.
PAIR_RULES = {
    "email_dot": (dot_key, F.lower, 85),
    "phone_normalization": (lambda x: F.nullif(digits(x), F.lit("")), lambda x: x, 90),
    "national_id_variant": (lambda x: F.nullif(F.upper(F.regexp_replace(x, r"[^\p{IsAlphabetic}\p{N}]", "")), F.lit("")), lambda x: x, 92),
    "user_id_variant": (lambda x: F.nullif(F.lower(F.regexp_replace(x, "[^0-9A-Fa-f]", "")), F.lit("")), lambda x: x, 88),
    "username_case": (F.lower, lambda x: x, 98),
}


def alias_links(values: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """L-02 to L-06: ``canonical, variant, alias_type, confidence`` of distinct values of one identity.

    Each identity is linked to its smallest spelling instead of all pairs, so a group costs its own size.
    """
    key, form, confidence = PAIR_RULES[kind]
    v = values.select(form(F.col(column)).alias("v")).where("v IS NOT NULL").distinct().withColumn("k", key(F.col("v")))
    v = v.where("k IS NOT NULL")
    least = v.groupBy("k").agg(F.min("v").alias("canonical"), F.count("*").alias("n")).where("n > 1")
    out = v.join(least, "k").where("v <> canonical")
    return out.select("canonical", F.col("v").alias("variant"), F.lit(kind).alias("alias_type"), F.lit(confidence).alias("confidence"))


def alias_pairs(left: DataFrame, right: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """The pair form: links between the values of two tables whose keys agree and whose texts differ."""
    key, form, confidence = PAIR_RULES[kind]
    a = left.select(form(F.col(column)).alias("canonical"), key(F.col(column)).alias("k"))
    b = right.select(form(F.col(column)).alias("variant"), key(F.col(column)).alias("k"))
    out = a.join(b, "k").where("canonical <> variant").drop("k")
    return out.withColumns({"alias_type": F.lit(kind), "confidence": F.lit(confidence)})


def canonical_forms(values: DataFrame, column: str = "value") -> DataFrame:
    """L-08: ``canonical_key, n, smallest, largest`` of groups of spellings that differ in dots or case only."""
    v = values.select(F.col(column).alias("v")).where("v IS NOT NULL").distinct()
    k = F.coalesce(dot_key(F.col("v")), F.lower("v"))
    return v.groupBy(k.alias("canonical_key")).agg(F.count("*").alias("n"), F.min("v").alias("smallest"), F.max("v").alias("largest"))
