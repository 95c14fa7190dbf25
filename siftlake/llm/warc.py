"""WARC archives as a Python data source named ``warc``: writer, and reader with pushed predicates.

Each record is a gzip member of its own that states its compressed length in an extra field, so that the reader inflates
only a record's headers, applies the predicates on record type and headers, and seeks past payloads of which neither
text, digest nor length is asked for; members without that field are inflated to their end, unread. Partitions are files,
small ones put together.

Defined results: a null html is an empty payload; a null page id is written without that header and read as null; among
equal payloads the largest page id is the response, rows that share it are all responses, null ids count as smallest;
an empty table gives an empty archive; columns of other names are ignored. A payload is held whole, about three times
its size for a moment, in the task that writes or decodes it. An archive that ends within a record raises ``EOFError``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from siftlake.llm.common import filesystem, materialize

SCHEMA = (
    "page_id long, record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, "
    "refers_to long, payload string"
)
#: Columns that can be answered from a record's headers, and the header of each.
HEADERS = {
    "page_id": "x-page-id", "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest", "payload_bytes": "x-payload-length", "refers_to": "x-refers-to-page-id",
}
LONGS = {"page_id", "payload_bytes", "refers_to"}
LISTING = "_files.json"
FILE_BYTES = 128 << 20
PARTITION_BYTES = 64 << 20
LEVEL = 6
#: Fixed value: the first bytes of a gzip member.
MAGIC = b"\x1f\x8b"
#: Fixed value: the profile that the WARC 1.1 format names for revisits of an equal payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def gzip_member(data: bytes) -> bytes:
    """A gzip member with an extra field ``sl``: the length of the whole member."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 8 + len(body) + 8
    head = MAGIC + b"\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHI", 8, b"sl", 4, total)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id, url, payload: bytes, record_type: str, refers_to, date: str) -> bytes:
    """One WARC record: an HTTP response, or a revisit of the response that holds the same payload."""
    length = len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {length}", f"Content-Length: {len(block)}",
    ]
    if url:
        clean = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        head.append(f"WARC-Target-URI: {clean}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if record_type == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", "2020-01-01T00:00:00Z")

    def write(self, batches):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        out, size, files = None, 0, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "record_type", "refers_to")]
            for page_id, url, html, kind, refers_to in zip(*cols, strict=True):
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                member = gzip_member(record(page_id, url, (html or "").encode(), kind, refers_to, self.date))
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        """Only the files of successful attempts are listed, and only listed files are read."""
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{LISTING}") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages):
        fs, root = filesystem(self.path)
        for m in messages:
            for x in m.files if m else []:
                fs.delete_file(f"{root}/{x}")


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns, self.schema = options["path"], schema.fieldNames(), schema
        self.wanted: dict[str, set] = {}
        if options.get("recordtypes"):
            self.wanted["record_type"] = set(options["recordtypes"].split(","))

    def pushFilters(self, filters):
        """Equality and membership on a header column are applied before payloads are touched; the rest is Spark's."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self):
        fs, root = filesystem(self.path)
        listing = f"{root}/{LISTING}"
        infos = fs.get_file_info(pafs.FileSelector(root))
        sizes = {i.base_name: i.size for i in infos if i.base_name.endswith((".warc", ".warc.gz"))}
        if any(i.path.endswith(LISTING) for i in infos):
            with fs.open_input_stream(listing) as f:
                sizes = {n: sizes[n] for n in json.loads(f.read())}
        out, size = [[]], 0
        for name, n in sorted(sizes.items()):
            if size and size + n > PARTITION_BYTES:
                out.append([])
                size = 0
            out[-1].append(name)
            size += n
        return [Files(x) for x in out]

    def read(self, partition):
        fs, root = filesystem(self.path)
        rows, size = [], 0
        for name in partition.names:
            with fs.open_input_file(f"{root}/{name}") as f:
                for row in self.records(f):
                    rows.append(row)
                    size += len(row[-1] or "") if self.columns[-1:] == ["payload"] else 64
                    if size > 4 << 20:
                        yield self.batch(rows)
                        rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows):
        kinds = [pa.int64() if c in LONGS else pa.string() for c in self.columns]
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], self.columns)

    def records(self, f):
        """Rows of one file that fit the predicates; raises where the file ends within a record."""
        decodes = {"payload", "payload_digest", "payload_bytes"} & {*self.columns}
        while magic := f.read(2):
            f.seek(f.tell() - len(magic))
            stream = (Member if magic == MAGIC else Plain)(f)
            head = stream.start()
            if head is None:
                return
            headers = {}
            for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
                key, _, value = line.partition(":")
                headers[key.strip().lower()] = value.strip()
            length = int(headers["content-length"])
            values = {c: self.value(c, headers) for c in HEADERS}
            if all(values[c] in want for c, want in self.wanted.items()):
                if decodes and values["record_type"] != "revisit":
                    block = stream.block(length)
                    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
                    values["payload_bytes"] = len(payload)
                    if "payload_digest" in decodes:
                        values["payload_digest"] = digest(payload)
                    if "payload" in decodes:
                        values["payload"] = payload.decode("utf-8", "replace")
                yield [values.get(c) for c in self.columns]
            stream.skip(length)

    @staticmethod
    def value(column: str, headers: dict):
        value = headers.get(HEADERS[column])
        if value is not None and column == "payload_digest":
            value = value.rpartition(":")[2].upper()
        return int(value) if value is not None and column in LONGS else value


def cut_short(f, what: str) -> EOFError:
    return EOFError(f"archive ends within {what}, at byte {f.tell()}")


class Plain:
    """An uncompressed record at the file's position."""

    def __init__(self, f):
        self.f, self.at, self.head_end = f, f.tell(), 0

    def start(self):
        """The record's head; None where only line ends are left."""
        data = b""
        while b"\r\n\r\n" not in data.lstrip():
            more = self.f.read(max(4096, len(data)))
            if not more:
                if data.strip():
                    raise cut_short(self.f, "the head of a record")
                return None
            data += more
        blank = len(data) - len(data.lstrip())
        head = data[blank:].partition(b"\r\n\r\n")[0]
        self.head_end = self.at + blank + len(head) + 4
        return head

    def block(self, n: int) -> bytes:
        self.f.seek(self.head_end)
        data = self.f.read(n)
        if len(data) < n:
            raise cut_short(self.f, "a block")
        return data

    def skip(self, n: int) -> None:
        end = self.head_end + n
        if end > self.f.size():
            raise cut_short(self.f, "a block")
        self.f.seek(min(end + 4, self.f.size()))


class Member:
    """A gzip member at the file's position, inflated only as far as somebody asks."""

    def __init__(self, f):
        self.f, self.at, self.data = f, f.tell(), b""

    def start(self):
        fixed = self.f.read(20)
        known = len(fixed) == 20 and fixed[3] & 4 and fixed[12:14] == b"sl"
        self.length = struct.unpack("<I", fixed[16:20])[0] if known else None
        if known and self.at + self.length > self.f.size():
            raise cut_short(self.f, "a gzip member")
        self.f.seek(self.at)
        self.inflater = zlib.decompressobj(31)
        while b"\r\n\r\n" not in self.data:
            if not self._more(max(2048, len(self.data))):
                raise cut_short(self.f, "the head of a record")
        head, _, self.data = self.data.partition(b"\r\n\r\n")
        return head

    def _more(self, most: int) -> bool:
        if self.inflater.eof:
            return False
        raw = self.inflater.unconsumed_tail or self.f.read(1 << 14)
        if not raw:
            return False
        self.data += self.inflater.decompress(raw, most)
        return True

    def block(self, n: int) -> bytes:
        parts = [self.data]
        have = len(self.data)
        while have < n:
            self.data = b""
            if not self._more(1 << 20):
                raise cut_short(self.f, "a block")
            parts.append(self.data)
            have += len(self.data)
        self.data = b"".join(parts)
        return self.data[:n]

    def skip(self, n: int) -> None:
        if self.length is not None:
            self.f.seek(self.at + self.length)
            return
        while not self.inflater.eof:
            self.data = b""
            if not self._more(1 << 20):
                raise cut_short(self.f, "a gzip member")
        self.f.seek(self.f.tell() - len(self.inflater.unused_data))


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; option ``recordTypes``; a given schema prunes columns."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, record_type, refers_to``: of equal payloads the largest page id is the response."""
    own = pages.select(F.col("page_id").cast("long"), "url", "html")
    own = own.withColumn("__digest", F.sha2(F.coalesce("html", F.lit("")), 256))  # SHA-1, as in the headers, has known collisions
    size = F.octet_length(F.coalesce("html", F.lit("")))
    groups = own.where(size >= least_bytes).groupBy("__digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keep"))
    groups = materialize(groups.where("n > 1 AND keep IS NOT NULL").select("__digest", "keep"), "warc-groups")
    joined = own.join(groups, "__digest", "left")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return joined.select(
        "page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keep")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    register(pages.sparkSession)
    with_roles(pages, least_bytes).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    register(spark)
    fields = dict(x.strip().split(" ") for x in SCHEMA.split(","))
    schema = ", ".join(f"{c} {fields[c]}" for c in columns or fields)
    return spark.read.format("warc").schema(schema).load(path)
