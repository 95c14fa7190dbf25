"""Hash functions, hash recognition and one-way forms of identifiers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftlake.functions.text import SPACE, digits, trim

#: Base64-like credentials must be at least this long to count as hashes.
BASE64_LEAST = 24


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def sha512(x: Column) -> Column:
    return F.sha2(x, 512)


md5, sha1 = F.md5, F.sha1


def md4(data: bytes) -> bytes:
    """MD4 (RFC 1320), which neither the JVM nor hashlib offers any more."""
    rotate = lambda v, n: ((v << n) | (v >> (32 - n))) & 0xFFFFFFFF
    message = data + b"\x80" + b"\0" * ((55 - len(data)) % 64) + struct.pack("<Q", 8 * len(data))
    state = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    plan = [
        (lambda b, c, d: (b & c) | (~b & d), 0, range(16), (3, 7, 11, 19)),
        (lambda b, c, d: (b & c) | (b & d) | (c & d), 0x5A827999, [i % 4 * 4 + i // 4 for i in range(16)], (3, 5, 9, 13)),
        (lambda b, c, d: b ^ c ^ d, 0x6ED9EBA1, [int(f"{i:04b}"[::-1], 2) for i in range(16)], (3, 9, 11, 15)),
    ]
    for at in range(0, len(message), 64):
        x = struct.unpack("<16I", message[at : at + 64])
        a, b, c, d = state
        for mixing, constant, order, turns in plan:
            for i, k in enumerate(order):
                new = rotate((a + (mixing(b, c, d) & 0xFFFFFFFF) + x[k] + constant) & 0xFFFFFFFF, turns[i % 4])
                a, b, c, d = d, new, b, c
        state = [(s + v) & 0xFFFFFFFF for s, v in zip(state, (a, b, c, d), strict=True)]
    return struct.pack("<4I", *state)


def ntlm_text(password: str) -> str:
    return md4(password.encode("utf-16-le")).hex()


@F.pandas_udf(StringType())
def ntlm(values: pd.Series) -> pd.Series:
    """H-02, meant for word lists."""
    return values.map(ntlm_text, na_action="ignore")


def row_hash(cells: Column) -> Column:
    """H-04 of normalised cells."""
    return sha256(F.array_join(cells, "|"))


# H-05: one-way forms for finding duplicates.
def hash_digits(x: Column) -> Column:
    return sha256(digits(x))


hash_phone = hash_ssn = hash_routing_number = hash_bank_account = hash_digits


def hash_credit_card(x: Column) -> Column:
    d = digits(x)
    return sha256(F.when(F.length(d) < 4, d).otherwise(F.concat(F.right(d, F.lit(4)), F.lit("_"), F.length(d))))


def hash_national_id(x: Column) -> Column:
    return sha256(F.upper(F.regexp_replace(x, f"[{SPACE}/-]", "")))


def hash_iban(x: Column) -> Column:
    return sha256(F.upper(F.regexp_replace(x, "[ -]", "")))


def hash_swift(x: Column) -> Column:
    return sha256(F.upper(F.regexp_replace(x, "-", "")))


def hash_token(x: Column) -> Column:
    return sha256(F.lower(trim(x)))


hash_crypto_address = hash_wallet_token = hash_token

_SALTED = [("bcrypt", r"\$2[aby]\$"), ("scrypt", r"\$7\$"), ("argon2", r"\$argon2(id|i|d)\$"), ("pbkdf2", r"\$pbkdf2-sha(256|512)\$")]
_UNSALTED = {32: "md5", 40: "sha1", 64: "sha256", 128: "sha512"}


def fingerprint(x: Column) -> Column:
    """H-06: ``struct<algorithm, is_weak>`` by salt prefix, or by length for all-hex values."""
    v = trim(x)
    name = F.lit("unknown")
    for size, algorithm in _UNSALTED.items():
        name = F.when(v.rlike(f"^[0-9A-Fa-f]{{{size}}}$"), algorithm).otherwise(name)
    for algorithm, prefix in reversed(_SALTED):
        name = F.when(v.rlike(f"^{prefix}"), algorithm).otherwise(name)
    return F.struct(name.alias("algorithm"), name.isin(*_UNSALTED.values()).alias("is_weak"))


def fingerprint_compat(x: Column) -> Column:
    """H-07: prefixes in any case, otherwise by byte length alone; the rest counts as ``sha256``, not weak."""
    name, weak = F.lit("sha256"), F.lit(False)
    for size, algorithm in _UNSALTED.items():
        name, weak = F.when(F.octet_length(x) == size, algorithm).otherwise(name), F.when(F.octet_length(x) == size, True).otherwise(weak)
    for algorithm, prefix in reversed(_SALTED):
        hit = x.rlike(f"(?i)^{prefix}")
        name, weak = F.when(hit, algorithm).otherwise(name), F.when(hit, False).otherwise(weak)
    return F.struct(name.alias("algorithm"), weak.alias("is_weak"))


def is_credential_hash(x: Column) -> Column:
    """H-08: a salted prefix, hex of a digest's length, or a base64-like text of ``BASE64_LEAST`` or more."""
    v = trim(x)
    salted = v.rlike("(?i)^(" + "|".join(p for _, p in _SALTED) + ")")
    hexadecimal = v.rlike("^[0-9A-Fa-f]+$") & F.length(v).isin(*_UNSALTED)
    base64 = v.rlike("^[A-Za-z0-9+/=]+$") & (F.length(v) % 4 == 0) & (F.length(v) >= BASE64_LEAST)
    return salted | hexadecimal | base64


def byte_sum(x: Column) -> Column:
    """H-09: the sum of the UTF-8 bytes of a text."""
    pairs = F.regexp_extract_all(F.hex(x), F.lit("(..)"), F.lit(1))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, p: a + F.conv(p, 16, 10).cast("long"))


def with_checksum(cells: Column, simple: bool = False) -> Column:
    """H-09: cells with ``checksum:<sum of bytes>`` appended, after ``len:<cells>`` in the simple form."""
    total = F.aggregate(F.transform(cells, byte_sum), F.lit(0).cast("long"), lambda a, n: a + n)
    tail = [F.concat(F.lit("checksum:"), total)]
    if simple:
        tail = [F.concat(F.lit("len:"), F.size(cells)), *tail]
    return F.concat(cells, F.array(*tail))


