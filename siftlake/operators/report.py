"""Findings, summaries and their output formats."""

from __future__ import annotations

import csv
import io
import json
import textwrap
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.detect import detect_pii, extract_email
from siftlake.functions.hashing import is_credential_hash
from siftlake.operators.risk import risk_distribution

#: Counters of the summary: name to the labels that count.
COUNTERS = {
    "emails": ["email"], "phones": ["phone_number"], "ips": ["ip_address", "ipv4", "ipv6"], "ssn": ["ssn"],
    "national_ids": ["national_id"], "cards": ["credit_card"], "names": ["name"], "addresses": ["mailing_address"],
    "bank": ["iban", "swift_code", "routing_number", "bank_account"], "crypto": ["crypto_address"], "wallets": ["digital_wallet"],
}


def findings(cells: DataFrame) -> DataFrame:
    """D-22: ``cells`` with ``labels``, ``email`` and ``is_hash``; needs ``value`` and ``col_name``.

    Dumps repeat values, but a detector pass costs less than a shuffle of the cells; it stays one narrow stage.
    """
    return cells.withColumns({
        "labels": detect_pii(F.col("value"), F.col("col_name")), "email": extract_email(F.col("value")),
        "is_hash": is_credential_hash(F.col("value")),
    })


def detected_rows(found: DataFrame) -> DataFrame:
    """D-22 by row: ``file_id, row_idx, findings, emails, has_hash``."""
    each = F.transform("labels", lambda x: F.struct(F.col("col_idx").alias("column"), F.col("value"), x.alias("type")))
    rows = found.groupBy("file_id", "row_idx").agg(
        F.array_sort(F.flatten(F.collect_list(each))).alias("findings"), F.array_sort(F.collect_list("email")).alias("emails"),
        F.max("is_hash").alias("has_hash"),
    )
    return rows


def detailed_findings(rows: DataFrame) -> DataFrame:
    """S-03: rows with findings and their number in the file; a header, where there is one, is row 0."""
    return rows.where(F.size("findings") > 0).withColumn("row_number", F.col("row_idx"))


def pii_summary(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """S-02: the counters over all findings, as one row (or one for each group)."""
    def counter(names: list[str]):
        return F.sum(F.size(F.filter("labels", lambda x: x.isin(*names))))

    counted = [counter(names).alias(name) for name, names in COUNTERS.items()]
    return found.groupBy(*(by or [])).agg(*counted)


def ingest_summary(rows: DataFrame, found: DataFrame, weak_hashes: DataFrame | None = None, weak_plain: DataFrame | None = None) -> DataFrame:
    """S-01 by file: rows with the header, rows with an e-mail, distinct e-mails, rows with hashes of weak passwords.

    ``weak_hashes`` and ``weak_plain``: cells that a probe found (``file_id, row_idx``); without the latter no weak
    passwords count, as plaintext is probed in strict mode only.
    """
    total = rows.where("row_idx IS NOT NULL").groupBy("file_id").agg(F.count("*").alias("rows_processed"))
    per_row = found.groupBy("file_id", "row_idx").agg(F.max(F.col("email").isNotNull()).alias("has"))
    stats = per_row.groupBy("file_id").agg(F.count_if("has").alias("unique_addresses"))
    distinct = found.groupBy("file_id").agg(F.count_distinct("email").alias("distinct_addresses"))
    out = total.join(stats, "file_id", "left").join(distinct, "file_id", "left")
    for name, cells in (("hashed_credentials", weak_hashes), ("weak_passwords", weak_plain)):
        if cells is None:
            out = out.withColumn(name, F.lit(0).cast("long"))
        else:
            out = out.join(cells.groupBy("file_id").agg(F.count_distinct("row_idx").alias(name)), "file_id", "left")
    return out.withColumn("breached_addresses", F.lit(0).cast("long")).na.fill(0)


def detailed_report(events: DataFrame, found: DataFrame, weak: DataFrame, aliases: DataFrame | None = None, risks: DataFrame | None = None) -> dict[str, DataFrame]:
    """S-08: the sections of the long report, each a table of its own; nothing is collected.

    ``aliases``: ``canonical, variant, alias_type, confidence`` (as of ``alias_links``); ``risks``: rows with ``file_id,
    row_idx`` and the fields of ``risk_score``. Without them their sections are left out.
    """
    kind = lambda k: events.where(F.col("event_type") == k)
    out = {
        "duplicate_rows": kind("duplicate_row").select("file_id", "row_idx", "row_hash"),
        "new_addresses": kind("new_address").select("file_id", "row_idx", "address_hash"),
        "compromised_with_new_credentials": kind("known_address_new_credential").select("file_id", "row_idx", "address_hash", "credential_hash"),
        "weak_passwords": weak.select("file_id", "row_idx").distinct(),
        "pii_by_row": detected_rows(found).select("file_id", "row_idx", "findings").where(F.size("findings") > 0),
        "pii_by_type": found.select(F.explode("labels").alias("pii_type")).groupBy("pii_type").agg(F.count("*").alias("n")),
    }
    if aliases is not None:
        out["aliases"] = aliases.groupBy("canonical", "alias_type").agg(
            F.count("*").alias("n"), F.min("variant").alias("first_variant"), F.max("confidence").alias("confidence")
        )
    if risks is not None:
        out["risk_by_row"] = risks.select("file_id", "row_idx", "score", "level", "explanation")
        out["risk_distribution"] = risk_distribution(risks)
    return out


Findings = Iterable[dict]


def stream_json(summary: dict, detailed: Findings = ()) -> Iterator[str]:
    """S-04: findings are left out where there are none."""
    dump = lambda x: json.dumps(x, indent=2, ensure_ascii=False, default=str)
    head, first = dump(summary), True
    for finding in detailed:
        if first:
            yield head[:-2] + (",\n" if summary else "") + '  "detailed_findings": [\n'
        yield ("" if first else ",\n") + textwrap.indent(dump(finding), "    ")
        first = False
    yield head if first else "\n  ]\n}"


def stream_csv(summary: dict, detailed: Findings = ()) -> Iterator[str]:
    """S-05."""
    out = io.StringIO()
    rows = csv.writer(out, lineterminator="\n")
    rows.writerow(["metric", "value"])
    for name in ("rows_processed", "unique_addresses", "hashed_credentials", "weak_passwords", "breached_addresses"):
        rows.writerow([name, summary.get(name, 0)])
    yield out.getvalue()


def stream_text(summary: dict, detailed: Findings = ()) -> Iterator[str]:
    """S-06: counters that are zero stay hidden."""
    yield "Summary\n" + "".join(f"  {k}: {v}\n" for k, v in summary.items() if not isinstance(v, dict))
    pii = {k: v for k, v in summary.get("pii", {}).items() if v}
    if pii:
        yield "Findings\n" + "".join(f"  {k}: {v}\n" for k, v in pii.items())
    for r in detailed:
        yield f"  row {r['row_number']}: " + ", ".join(f"{f['type']} in column {f['column']}" for f in r["findings"]) + "\n"


def stream_jsonl(summary: dict, detailed: Findings = ()) -> Iterator[str]:
    """S-07: a line for the summary, one for the metadata, one for each error."""
    dump = lambda kind, x: json.dumps({"event": kind, **x}, ensure_ascii=False, default=str) + "\n"
    yield dump("summary", {k: v for k, v in summary.items() if k not in ("metadata", "errors")})
    yield dump("metadata", summary.get("metadata", {}))
    for e in summary.get("errors", []):
        yield dump("error", {"message": e})


def joined(stream: Callable[..., Iterator[str]]) -> Callable[..., str]:
    return lambda summary, detailed=(): "".join(stream(summary, detailed))


format_json, format_csv, format_text, format_jsonl = map(joined, (stream_json, stream_csv, stream_text, stream_jsonl))

#: K-04: pieces of text of a summary and its findings, one after another.
FORMATTERS: dict[str, Callable[..., Iterator[str]]] = {"json": stream_json, "csv": stream_csv, "text": stream_text, "jsonl": stream_jsonl}
