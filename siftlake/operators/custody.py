"""Chain of custody and evidence records: signed JSON messages (Ed25519 of the JVM), file identity, deletion, locks."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import secrets
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What can happen to a file.
ACTIONS = [
    "file_ingested", "file_validated", "duplication_check", "enrichment_complete", "data_stored", "temporary_files_deleted",
    "processing_complete",
]


class TamperError(ValueError):
    """A custody record whose signature does not fit its content."""


@dataclass(frozen=True)
class CustodyRecord:
    """M-05: eight signed fields, then signature and public key as hex."""

    record_id: str
    file_id: str
    custody_action: str
    operator: str
    file_hash: str
    file_size: int
    record_count: int
    timestamp: str
    signature: str = ""
    public_key: str = ""

    def __post_init__(self):
        if self.custody_action not in ACTIONS:
            raise ValueError(f"unknown action: {self.custody_action}")

    def message(self) -> bytes:
        fields = {k: v for k, v in asdict(self).items() if k not in ("signature", "public_key")}
        return json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()


class Signer:
    """An Ed25519 key pair held by the driver's JVM."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.pair = self.jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()

    @property
    def public_key(self) -> str:
        security = self.jvm.java.security
        kind = self.jvm.java.lang.Class.forName("java.security.spec.X509EncodedKeySpec")
        spec = security.KeyFactory.getInstance("Ed25519").getKeySpec(self.pair.getPublic(), kind)
        return bytes(spec.getEncoded()).hex()

    def sign(self, record: CustodyRecord) -> CustodyRecord:
        s = self.jvm.java.security.Signature.getInstance("Ed25519")
        s.initSign(self.pair.getPrivate())
        s.update(record.message())
        return CustodyRecord(**asdict(record) | {"signature": bytes(s.sign()).hex(), "public_key": self.public_key})


def verify_record(spark: SparkSession, record: CustodyRecord) -> None:
    """Raises ``TamperError`` unless the signature fits."""
    security = spark._jvm.java.security
    key = security.KeyFactory.getInstance("Ed25519").generatePublic(security.spec.X509EncodedKeySpec(bytes.fromhex(record.public_key)))
    s = security.Signature.getInstance("Ed25519")
    s.initVerify(key)
    s.update(record.message())
    try:
        good = s.verify(bytes.fromhex(record.signature))
    except Exception:
        good = False
    if not good:
        raise TamperError(record.record_id)


def evidence(files: DataFrame) -> DataFrame:
    """M-06: ``evidence_id, file_id, sha256, names, size`` of files, one row for each content."""
    names = F.array_sort(F.collect_set("path")).alias("alternate_names")
    out = files.groupBy("file_id").agg(names, F.first("size").alias("size"))
    return out.select(F.concat(F.uuid(), F.lit("-"), F.unix_timestamp()).alias("evidence_id"), "file_id", F.col("file_id").alias("sha256"), "alternate_names", "size")


def verify_evidence(files: DataFrame, records: DataFrame) -> DataFrame:
    """``path, intact`` of files whose evidence is on record by path."""
    known = records.select(F.explode("alternate_names").alias("path"), F.col("sha256"))
    return files.join(known, "path").select("path", (F.col("file_id") == F.col("sha256")).alias("intact"))


def secure_delete(path: str | os.PathLike, passes: int = 3) -> None:
    """M-07: zeros, ones and random bytes over the file, then unlinks it. No promise on copy-on-write disks."""
    path = Path(path)
    size = path.stat().st_size
    with path.open("r+b") as f:
        for n in range(max(1, min(passes, 3))):
            f.seek(0)
            for at in range(0, size, 1 << 20):
                k = min(1 << 20, size - at)
                f.write((b"\0" * k, b"\xff" * k, secrets.token_bytes(k))[n])
            f.flush()
            os.fsync(f.fileno())
    path.unlink()


@contextlib.contextmanager
def file_lock(path: str | os.PathLike) -> Iterator[Path]:
    """M-08: an exclusively created lock file beside ``path``; ``FileExistsError`` if held."""
    lock = Path(f"{path}.lock")
    os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
    try:
        yield lock
    finally:
        lock.unlink(missing_ok=True)


@contextlib.contextmanager
def working_copy(source: str | os.PathLike, folder: str | os.PathLike) -> Iterator[Path]:
    """A-19: a private copy of an input under a name of its own, removed afterwards."""
    folder = Path(folder) / f"wc-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
    folder.mkdir(mode=0o700, parents=True)
    try:
        yield Path(shutil.copy2(source, folder))
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def file_digest(path: str | os.PathLike) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
