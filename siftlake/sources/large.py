"""CSV and TSV files of any size, split over tasks, with the state of quotes carried across the splits.

A quote toggles wherever it stands, so a split cannot tell by itself whether it begins within quotes. A first pass reports
for each split the parity of its quotes and how many rows end in it under either state; running over the splits of a file
(one row each) these give every split its state and the number of its first row. A second pass reads the rows. What is cut
off at the borders of splits (the start of a row, its end, whole splits within quotes) is put together by row number.

Defined results: those of the whole-file parser, but for a line end that closes a file within open quotes, which is dropped,
and a quote pair alone at the very end of a file, which is a row. Rows are at most 2 GB, as all strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.scratch import written
from siftlake.sources.parsers import parse_csv

#: Splits whose states are broadcast (some hundred bytes each); beyond, lines are shuffled to their split's state.
BROADCAST_SPLITS = 200_000
ROW = "path string, row_idx long, cells array<string>, piece string, start long"


def split_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, start, n, value``: lines by file and split (the byte it starts at), numbered in their order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")]
    return lines.select(*at, F.monotonically_increasing_id().alias("n"), F.make_valid_utf8("value").alias("value"))


def split_states(lines: DataFrame, quote: str = '"') -> DataFrame:
    """``path, start, quoted, first``: whether a split starts within quotes, and the number of the first row that ends in it."""

    def run(batches):
        names, kinds = ["path", "start", "odd", "outside", "within"], [pa.string(), *[pa.int64()] * 4]
        open_split, counts = None, [0, 0, 0]  # parity of quotes, rows that end if it starts outside quotes, and within
        for batch in batches:
            out = []
            for path, start, value in zip(*(batch[c].to_pylist() for c in ("path", "start", "value")), strict=True):
                if (path, start) != open_split:
                    if open_split:
                        out.append((*open_split, *counts))
                    open_split, counts = (path, start), [0, 0, 0]
                counts[0] ^= value.count(quote) & 1 if quote else 0
                counts[1 + counts[0]] += 1
            yield from _records(out, names, kinds)
        if open_split:
            yield from _records([(*open_split, *counts)], names, kinds)

    splits = lines.select("path", "start", "value").mapInArrow(run, "path string, start long, odd long, outside long, within long")
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)  # one row for each split
    splits = splits.withColumn("quoted", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    splits = splits.withColumn("ends", F.when(F.col("quoted"), F.col("within")).otherwise(F.col("outside")))
    return splits.select("path", "start", "quoted", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first"))


def _records(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    if rows:
        cols = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def one_row(text: str) -> list[str]:
    """The cells of a row whose quotes are closed, or of the rest of a file."""
    if '"' not in text:
        return text.replace("\r", "").split(",")
    rows = parse_csv(text if text.count('"') & 1 else text + "\n")
    return rows[0] if rows else [""]


def split_rows(lines: DataFrame, states: DataFrame, few: bool, quote: str = '"') -> DataFrame:
    """``ROW``: whole rows with ``cells``, and the pieces of rows that cross a border with ``piece``."""

    def run(batches):
        names, kinds = ["path", "row_idx", "cells", "piece", "start"], [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64()]
        split, row, quoted, cut, part = None, 0, False, False, []
        for batch in batches:
            out = []
            for path, start, value, within, first in zip(*(batch[c].to_pylist() for c in ("path", "start", "value", "quoted", "first")), strict=True):
                if (path, start) != split:
                    if part:
                        out.append((split[0], row, None, "\n".join(part), split[1]))
                    split, row, quoted, cut, part = (path, start), first, within, within, []
                part.append(value)
                quoted ^= bool(quote and value.count(quote) & 1)
                if not quoted:
                    text = "\n".join(part)
                    out.append((path, row, None, text, start) if cut else (path, row, one_row(text) if quote else text.removesuffix("\r").split("\t"), None, None))
                    row, cut, part = row + 1, False, []
            yield from _records(out, names, kinds)
        if part:
            yield from _records([(split[0], row, None, "\n".join(part), split[1])], names, kinds)

    if few:
        joined = lines.join(F.broadcast(states), ["path", "start"])
    else:
        joined = lines.join(states, ["path", "start"]).repartition("path", "start").sortWithinPartitions("path", "start", "n")
    return joined.select("path", "start", "value", "quoted", "first").mapInArrow(run, ROW)


def read_rows(spark: SparkSession, path: str | list[str], quote: str = '"') -> DataFrame:
    """``path, row_idx, cells`` of CSV files, however large; without a ``quote`` of TSV files. Parsed once and written."""
    lines = split_lines(spark, path)
    states = written(split_states(lines, quote), "splits")
    rows = written(split_rows(lines, states, states.count() <= BROADCAST_SPLITS, quote), "split-rows")
    whole = rows.where("cells IS NOT NULL").select("path", "row_idx", "cells")
    pieces = rows.where("piece IS NOT NULL").groupBy("path", "row_idx").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("parts"))
    pieces = pieces.select("path", "row_idx", F.array_join(F.transform("parts", lambda p: p["piece"]), "\n").alias("text"))

    def join(batches):
        for batch in batches:
            cells = pa.array([one_row(t) for t in batch["text"].to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch["path"], batch["row_idx"], cells], ["path", "row_idx", "cells"])

    return whole.unionByName(pieces.mapInArrow(join, "path string, row_idx long, cells array<string>"))


def content_id(lines: DataFrame) -> DataFrame:
    """``path, file_id``: a digest of a file's lines that needs no task to read the whole file and does not depend on splits."""
    each = [F.xxhash64(F.lit(seed), "value").cast("decimal(20,0)") for seed in (1, 2, 3, 4)]
    sums = [F.sum(x).cast("string") for x in each]
    return lines.groupBy("path").agg(F.sha2(F.concat_ws("|", *sums, F.count("*").cast("string"), F.sum(F.octet_length("value")).cast("string")), 256).alias("file_id"))
