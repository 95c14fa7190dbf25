"""Dump files as DataFrames: files, rows of cells, long cells; safety and compression checks on bytes.

``load_dump`` parses each file exactly: files up to ``LARGE`` in one task, larger CSV and TSV files split over tasks
(``large``). JSON and XML files are single documents and stay whole. Files of lines that need no state across lines (JSON
lines, CSV without line breaks in quotes) can also go through ``load_lines``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.text import SPACE
from siftlake.sources import large
from siftlake.sources.parsers import PARSERS, json_line, parse_csv_line, parser_of

ROWS = "file_seq long, path string, file_id string, row_idx long, cells array<string>, error string"
LARGE = 100 * 1024 * 1024


def dump_format(path: Column) -> Column:
    """A-13: the lower-cased extension, ``csv`` without one; null where unsupported."""
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    ext = F.when(ext == "", "csv").otherwise(ext)
    return F.when(ext.isin(*PARSERS), ext)  # with the adapters that were added


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A-12, F-01: ``path, file_id, md5, size, content``; raises if nothing matches."""
    df = spark.read.format("binaryFile").load(paths)
    return df.select("path", F.sha2("content", 256).alias("file_id"), F.md5("content").alias("md5"), F.col("length").alias("size"), "content")


def load_dump(spark: SparkSession, paths: list[str] | str, fmt: str | None = None) -> DataFrame:
    """Rows ``ROWS`` of all files, in the order of ``paths``; unreadable files give one row with an error.

    The ``file_id`` of a large CSV or TSV file is a digest of its lines instead of its bytes; it is not checked for binary
    content.
    """
    paths = [paths] if isinstance(paths, str) else paths
    parts = []
    kind = F.lit(fmt) if fmt else dump_format(F.col("path"))
    for i, p in enumerate(paths):
        files = read_files(spark, p).withColumns({"file_seq": F.lit(i).cast("long"), "fmt": kind})
        splits = (F.col("size") > LARGE) & F.coalesce(kind.isin("csv", "tsv"), F.lit(False))
        parts.append(_whole(files.where(~splits)))
        for r in files.where(splits).select("path", "fmt").collect():  # one name for each file over LARGE
            rows = large.read_rows(spark, r.path, '"' if r.fmt == "csv" else "")
            file_id = large.content_id(large.split_lines(spark, r.path)).select("file_id").scalar()
            error = F.lit(None).cast("string").alias("error")
            parts.append(rows.select(F.lit(i).cast("long").alias("file_seq"), "path", file_id.alias("file_id"), "row_idx", "cells", error))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _whole(files: DataFrame) -> DataFrame:
    """Rows ``ROWS`` of files that one task each parses."""
    files = files.withColumns({"safe": file_safety(F.col("content")), "text": F.make_valid_utf8(F.col("content").cast("string"))})

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows, error = [], None
                if r["is_binary"]:
                    error = "binary content"
                elif r["fmt"] not in parsers:
                    error = "unsupported format"
                else:
                    try:
                        rows = parsers[r["fmt"]](r["text"])
                    except ValueError as e:
                        error = str(e)
                out = [(r["file_seq"], r["path"], r["file_id"], i, c, None) for i, c in enumerate(rows)]
                if error:
                    out = [(r["file_seq"], r["path"], r["file_id"], None, None, error)]
                cols = list(zip(*out, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()]
                names = ["file_seq", "path", "file_id", "row_idx", "cells", "error"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    parsers = {name: parser_of(name) for name in PARSERS}  # travels to the executors with the function
    return files.select("file_seq", "path", "file_id", "fmt", "text", F.col("safe.is_binary").alias("is_binary")).mapInArrow(run, ROWS)


def load_lines(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """``path, cells, error, bytes`` line by line (A-02, A-08, A-09), for batch; large files are split over tasks."""
    return parse_lines(spark.read.text(path).withColumn("path", F.input_file_name()), fmt)


def parse_lines(lines: DataFrame, fmt: str) -> DataFrame:
    """The line parsers over ``value``, for batch and streams: bad lines keep an error, blank lines go (A-08, A-09)."""
    value = F.col("value")
    size = F.octet_length(value) + 1
    if fmt == "tsv":
        return lines.select("path", F.split(value, "\t").alias("cells"), F.lit(None).cast("string").alias("error"), size.alias("bytes"))

    def run(batches):
        import json

        for batch in batches:
            cells, errors = [], []
            for line in batch["value"].to_pylist():
                try:
                    cells.append(parse_csv_line(line.rstrip()) if fmt == "csv" else json_line(json.loads(line)))
                    errors.append(None)
                except ValueError as e:
                    cells.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays(
                [batch["path"], pa.array(cells, pa.list_(pa.string())), pa.array(errors, pa.string()), batch["bytes"]],
                ["path", "cells", "error", "bytes"],
            )

    kept = lines.where(value.rlike(f"[^{SPACE}]")).select("path", "value", size.alias("bytes"))
    return kept.mapInArrow(run, "path string, cells array<string>, error string, bytes int")


def parse_statistics(parsed: DataFrame) -> DataFrame:
    """A-11: ``path, rows_processed, rows_failed, bytes_read, warnings`` of parsed lines."""
    failed = F.col("error").isNotNull()
    return parsed.groupBy("path").agg(
        F.count_if(~failed).alias("rows_processed"), F.count_if(failed).alias("rows_failed"), F.sum("bytes").alias("bytes_read"),
        F.array_sort(F.collect_set("error")).alias("warnings"),  # a handful of different messages
    )


def observed(parsed: DataFrame, name: str) -> DataFrame:
    """The same counters as an observation, for streams and writes."""
    failed = F.col("error").isNotNull()
    return parsed.observe(
        name, F.count_if(~failed).alias("rows_processed"), F.count_if(failed).alias("rows_failed"), F.sum("bytes").alias("bytes_read")
    )


def is_header(cells: Column) -> Column:
    """A-14: any letter in any cell of the first row."""
    return F.exists(cells, lambda c: c.rlike(r"\p{IsAlphabetic}"))


def split_header(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``headers`` (``file_id, header``; files without one are absent) and the data rows with their ``header``."""
    heads = rows.where((F.col("row_idx") == 0) & is_header(F.col("cells"))).select("file_id", F.col("cells").alias("header"))
    data = rows.where(F.col("row_idx").isNotNull()).join(heads, "file_id", "left")
    return heads, data.where(F.col("header").isNull() | (F.col("row_idx") > 0))


def long_cells(rows: DataFrame) -> DataFrame:
    """``file_seq, file_id, row_idx, col_idx, col_name, value`` of rows with their ``header`` (null: no header)."""
    out = rows.select("file_seq", "file_id", "row_idx", "header", F.posexplode("cells").alias("col_idx", "value"))
    return out.withColumn("col_name", F.get("header", F.col("col_idx"))).drop("header")


def file_safety(content: Column) -> Column:
    """A-15: ``struct<is_safe, is_binary, confidence, warnings>`` of a file's bytes."""
    size = F.octet_length(content)
    latin = F.decode(content, "iso-8859-1")
    odd = F.length(F.regexp_replace(latin, "[ -~\\t\\n\\r\\u0080-\\u00ff]", ""))
    ratio = F.when(size > 0, odd / size).otherwise(F.lit(0.0))
    magic2, magic4 = F.hex(F.substring(content, 1, 2)), F.hex(F.substring(content, 1, 4))
    percent = F.floor(ratio * 100)
    confidence = F.greatest(
        F.when(latin.contains("\u0000"), 95).otherwise(0),
        F.when(ratio > 0.3, F.least(percent, F.lit(80))).when(ratio > 0.1, F.floor(10 + ratio * 200)).otherwise(0),
        F.when(~F.is_valid_utf8(content.cast("string")), 40).otherwise(0),
        F.when(magic4 == "7F454C46", 99).when(magic2 == "4D5A", 98).when(magic4.rlike("^(FEED|CEFA)"), 98).otherwise(0),
    ).cast("int")
    binary = latin.contains("\u0000") | (ratio > 0.3) | (magic4 == "7F454C46") | (magic2 == "4D5A") | magic4.rlike("^(FEED|CEFA)")
    warnings = F.filter(
        F.array(F.when(size == 0, "empty file"), F.when(size > LARGE, "large file"), F.when(binary, "binary content"),
                F.when(~F.is_valid_utf8(content.cast("string")), "invalid UTF-8")),
        lambda w: w.isNotNull(),
    )
    return F.struct((~binary & (size > 0)).alias("is_safe"), binary.alias("is_binary"), confidence.alias("confidence"), warnings.alias("warnings"))


def compression(content: Column, path: Column) -> Column:
    """A-17: ``struct<kind, extension>`` by magic bytes."""
    two, six = F.hex(F.substring(content, 1, 2)), F.hex(F.substring(content, 1, 6))
    kind = (
        F.when(two == "504B", "zip").when(two == "1F8B", "gzip").when(two == "425A", "bzip2")
        .when(six.startswith("377A5C24") | (six == "377ABCAF271C"), "7z").otherwise("none")
    )
    return F.struct(kind.alias("kind"), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("extension"))


def check_nesting(level: Column, most: int = 3) -> Column:
    """A-18: true, or an error beyond ``most`` levels of archives in archives."""
    return F.when(level <= most, True).otherwise(F.raise_error(F.concat(F.lit("nesting too deep: "), level)).cast("boolean"))
