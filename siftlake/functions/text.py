"""Text normalisation: Unicode-equivalent cell values, e-mails, phones, addresses (built-in functions first)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Unicode White_Space as a Java and Python character class body.
SPACE = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = re.compile(f"[{SPACE}]+")
#: Typographic signs that count as their plain forms.
PLAIN_SIGNS = {"\u2019": "'", "\u2018": "'", "\u2013": "-", "\u2014": "-"}
_SIGNS = str.maketrans(PLAIN_SIGNS)
#: Characters whose normal form is their lower case (and ``ss`` for the sharp s, plain forms for the typographic signs), that
#: compose with none of each other: ASCII, letters of Latin-1 and Latin Extended-A, Cyrillic, kana, Han, Hangul syllables
#: and some signs. Texts of these alone stay in built-in functions.
SIMPLE = (
    "\\x00-\\x7f\\u00a1-\\u00a7\\u00a9\\u00ab\\u00ac\\u00ae\\u00b0\\u00b1\\u00b6\\u00b7\\u00bb\\u00bf-\\u012f\\u0131\\u0134-\\u013e"
    "\\u0141-\\u0148\\u014a-\\u017e\\u0410-\\u044f\\u0401\\u0451\\u2010\\u2012-\\u2016\\u2018-\\u201f\\u2020-\\u2022\\u20ac\\u3001-\\u3003\\u3008-\\u3011"
    "\\u3041-\\u3096\\u30a1-\\u30fa\\u30fc\\u4e00-\\u9fff\\uac00-\\ud7a3"
)

#: Default domain rules, canonical domain to the domains that count as the same.
SUFFIX_RULES = {
    "bofa.com": ["bankofamerica.com", "ml.com"],
    "gmail.com": ["googlemail.com"],
    "yahoo.com": ["ymail.com", "rocketmail.com"],
    "microsoft.com": ["outlook.com", "hotmail.com", "live.com"],
    "amazon.com": ["aws.amazon.com"],
}

#: Country codes to phone prefixes.
PHONE_PREFIXES = {
    "US": "1", "CA": "1", "GB": "44", "UK": "44", "FR": "33", "DE": "49", "IT": "39", "ES": "34", "AU": "61",
    "JP": "81", "CN": "86", "IN": "91", "MX": "52", "BR": "55", "NL": "31", "CH": "41", "SE": "46",
}


def trim(x: Column) -> Column:
    """``x`` without Unicode white space at both ends."""
    return F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def normalize_text(text: str) -> str:
    """NFKC, full case folding, plain quotes and dashes, single blanks, trimmed."""
    folded = unicodedata.normalize("NFKC", _SPACES.sub(" ", text)).casefold().translate(_SIGNS)
    return _SPACES.sub(" ", folded).strip(" ")


@F.pandas_udf(StringType())
def _normalize_unicode(values: pd.Series) -> pd.Series:
    return values.map(normalize_text, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _normalize_cells(rows: pd.Series) -> pd.Series:
    return rows.map(lambda cells: None if cells is None else [normalize_text(c or "") for c in cells])


def is_simple(x: Column) -> Column:
    """Whether built-in functions normalise a text as ``normalize_text`` does."""
    return (F.octet_length(x) == F.length(x)) | ~x.rlike(f"[^{SIMPLE}]")


def _plain(x: Column) -> Column:
    """``normalize_text`` of simple texts."""
    signs = F.translate(F.replace(F.lower(x), F.lit("\u00df"), F.lit("ss")), "".join(PLAIN_SIGNS), "".join(PLAIN_SIGNS.values()))
    return F.btrim(F.regexp_replace(signs, "[\\t-\\r ]+", " "))


def normalize_field(x: Column) -> Column:
    """B-01. Simple texts stay in built-in functions; only other values cross to the Arrow function, the rest as nulls."""
    simple = is_simple(x)
    return F.when(simple, _plain(x)).otherwise(_normalize_unicode(F.when(~simple, x)))


def normalize_row(cells: Column) -> Column:
    """B-02 for ``array<string>``: cells of simple rows one by one, those of other rows in one Arrow call; null cells are empty."""
    simple = F.forall(cells, lambda c: c.isNull() | is_simple(c))
    plain = F.transform(cells, lambda c: _plain(F.coalesce(c, F.lit(""))))
    return F.when(simple, plain).otherwise(_normalize_cells(F.when(~simple, cells)))


def suffix_map(rules: dict[str, list[str]] | None = None) -> Column:
    """B-04: a literal map of alternate domains to canonical ones."""
    pairs = [(alt, canon) for canon, alts in (rules or SUFFIX_RULES).items() for alt in alts]
    return F.create_map(*[F.lit(v) for pair in pairs for v in pair])


def normalize_email(x: Column, rules: dict[str, list[str]] | None = None) -> Column:
    """B-03: normalised address without ``+`` tag and dots, canonical domain; other text just normalised."""
    v = normalize_field(x)
    local, domain = F.regexp_extract(v, "^(.*)@([^@]*)$", 1), F.regexp_extract(v, "^(.*)@([^@]*)$", 2)
    base = F.regexp_replace(F.regexp_replace(local, "\\+.*$", ""), "\\.", "")
    canonical = F.coalesce(F.try_element_at(suffix_map(rules), domain), domain)
    return F.when(v.contains("@"), F.concat(base, F.lit("@"), canonical)).otherwise(v)


def normalize_phone_e164(phone: Column, country: Column) -> Column:
    """B-05; null where there is no digit or the country is unknown."""
    d = digits(phone)
    prefix = F.try_element_at(F.create_map(*[F.lit(v) for kv in PHONE_PREFIXES.items() for v in kv]), F.upper(country))
    number = F.when(d.startswith(prefix) | phone.startswith("+"), F.concat(F.lit("+"), d)).otherwise(F.concat(F.lit("+"), prefix, d))
    return F.when((d != "") & prefix.isNotNull(), number)


def normalize_ip(x: Column) -> Column:
    return F.lower(trim(x))


normalize_name = normalize_address = normalize_field
