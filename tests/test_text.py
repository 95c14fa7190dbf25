import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.functions import hashing, text

PAIRS = [
    ("José", "José"), ("Straße", "STRASSE"), ("İ", "i̇"), ("ﬁn", "FIN"), ("ＡＢＣ", "abc"), ("Σς", "σσ"),
    ("it’s", "it's"), ("a–b", "a-b"), ("a  b", "A B"), ("½", "1⁄2"), ("  x  ", "x"),
]


@pytest.mark.parametrize("a,b", PAIRS)
def test_equivalent(a, b):
    assert text.normalize_text(a) == text.normalize_text(b)


@given(st.text(max_size=40) | st.sampled_from(["𝕆", "ﹰ"]))
@settings(max_examples=300, deadline=None)
def test_normalisation_properties(s):
    once = text.normalize_text(s)
    assert not any("A" <= c <= "Z" for c in once)
    assert "  " not in once
    if unicodedata.normalize("NFKC", once) == once:
        assert text.normalize_text(once) == once


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_column_equals_python(spark):
    values = ["  Ab \t c ", "STRASSE", "Straße", "ﬁ ’x’", "", None, "a\x1fb", "İstanbul"]
    want = [None if v is None else text.normalize_text(v) for v in values]
    assert column(spark, values, text.normalize_field) == want


def test_row(spark):
    df = spark.createDataFrame([(["A ", None, "Straße", ""],), ([],), (["x"],)], "c array<string>")
    assert [r.x for r in df.select(text.normalize_row(F.col("c")).alias("x")).collect()] == [["a", "", "strasse", ""], [], ["x"]]


def test_row_keeps_private_use_characters(spark):
    rows = [["a\ue000b", "c"], ["\uf8ff", "", "x\U000f0000"], ["\ue000"], ["Ａ", "\ue000\ue001", None]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c array<string>").orderBy("i")
    got = [r.x for r in df.select("i", text.normalize_row(F.col("c")).alias("x")).orderBy("i").collect()]
    assert got == [[text.normalize_text(c or "") for c in r] for r in rows]


def test_simple_characters_are_those_that_builtins_normalise(spark):
    """Each one by itself, between letters, and before and after each kind of the others."""
    simple = [chr(c) for c in range(0x10000) if re.fullmatch(f"[{text.SIMPLE}]", chr(c))]
    assert len(simple) > 30_000 and all(unicodedata.normalize("NFKC", c) == c and unicodedata.combining(c) == 0 for c in simple)
    some = simple[:700] + simple[700::97]
    values = [f"A{c}b{c}{c}Z" for c in simple] + [a + b for a in some[::9] for b in some[::5]]
    df = spark.createDataFrame([(v, text.normalize_text(v)) for v in values], "v string, want string")
    assert df.where(~text.is_simple(F.col("v"))).count() == 0
    assert df.where(text.normalize_field(F.col("v")) != F.col("want")).limit(5).collect() == []


def test_emails(spark):
    got = column(spark, ["User.Name+tag@GoogleMail.com", "plain", "a@b@ML.com", "x@y.org"], text.normalize_email)
    assert got == ["username@gmail.com", "plain", "a@b@bofa.com", "x@y.org"]


def test_phones(spark):
    df = spark.createDataFrame(
        [("(555) 123-4567", "US"), ("+1-555-123-4567", "us"), ("020 7946", "GB"), ("+99 1", "FR"), ("none", "US"), ("1", "XX")], "p string, c string"
    )
    got = [r.x for r in df.select(text.normalize_phone_e164(F.col("p"), F.col("c")).alias("x")).collect()]
    assert got == ["+15551234567", "+15551234567", "+440207946", "+991", None, None]


def test_md4_and_ntlm():
    vectors = {
        b"": "31d6cfe0d16ae931b73c59d7e0c089c0", b"abc": "a448017aaf21d8525fc10ae87aa6729d",
        b"message digest": "d9130a8164549fe818874806e1c7014b", b"1234567890" * 8: "e33b4ddc9c38f2199c3e7b164fcc0536",
    }
    assert {k: hashing.md4(k).hex() for k in vectors} == vectors
    assert hashing.ntlm_text("password") == "8846f7eaee8fb117ad06bdd830b7586c"


def test_one_way_forms(spark):
    same = lambda f, a, b: len(set(column(spark, [a, b], f))) == 1
    assert same(hashing.hash_national_id, "AB12-34-56-C", "ab 12 34 56 c")
    assert same(hashing.hash_credit_card, "4532015112830366", "4111111111110366")
    assert same(hashing.hash_iban, "DE89 3704", "de89-3704")
    assert not same(hashing.hash_phone, "+1-555-123-4567", "555-123-4567")


def test_fingerprints(spark):
    values = ["a" * 32, "a" * 40, "z" * 32, "$2y$10$x", "$ARGON2ID$x", "plain"]
    got = column(spark, values, hashing.fingerprint)
    assert [g.algorithm for g in got] == ["md5", "sha1", "unknown", "bcrypt", "unknown", "unknown"]
    got = column(spark, values, hashing.fingerprint_compat)
    assert [(g.algorithm, g.is_weak) for g in got][2:] == [("md5", True), ("bcrypt", False), ("argon2", False), ("sha256", False)]
