"""Command line: ingest, status, stats, export-db, import-db, generate-tables."""

from __future__ import annotations

import argparse
import contextlib
import json
import sys
from collections.abc import Iterator

from pyspark.sql import functions as F

from siftlake import config
from siftlake.operators import report, wordlist
from siftlake.operators.events import event_log
from siftlake.operators.history import HistoryStore
from siftlake.operators.sync import JobLog
from siftlake.scratch import written
from siftlake.session import session
from siftlake.sources import dumps

#: Different error messages in a summary, the most frequent first.
ERRORS = 1000


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftlake", description=__doc__)
    top.add_argument("--config")
    sub = top.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest")
    ingest.add_argument("inputs", nargs="+")
    ingest.add_argument("--format", choices=[*dumps.PARSERS])
    ingest.add_argument("--output-format", choices=[*report.FORMATTERS], default="json")
    ingest.add_argument("--output")
    ingest.add_argument("--database", help="history store to add the events to")
    ingest.add_argument("--findings", help="folder for the findings as JSON lines; without it they follow the summary")
    for name in ("stats", "status", "export-db", "import-db"):
        p = sub.add_parser(name)
        p.add_argument("--database", required=True)
        if name.endswith("-db"):
            p.add_argument("path")
        if name == "status":
            p.add_argument("job", nargs="?", help="id of a job; without it the latest are listed")
    tables = sub.add_parser("generate-tables")
    tables.add_argument("--words", help="folder of word lists")
    tables.add_argument("--output", required=True)
    return top


def run_ingest(spark, args, cfg) -> Iterator[str]:
    """The report in pieces. Findings go from executors to ``--findings``, or through the driver a partition at a time."""
    rows = written(dumps.load_dump(spark, args.inputs, args.format), "rows")
    _, data = dumps.split_header(rows)
    found = written(report.findings(dumps.long_cells(data)), "found")
    hashes = wordlist.digests(wordlist.rainbow_table(wordlist.builtin_words(spark, cfg.custom_passwords), with_ntlm=False))
    weak = wordlist.weak_hash_probe(dumps.long_cells(data), "value", hashes).where("plaintext IS NOT NULL")
    total = report.ingest_summary(rows, found, weak).drop("file_id").groupBy().sum().first().asDict()
    summary = {k[4:-1]: v for k, v in total.items()} | {"pii": report.pii_summary(found).first().asDict()}
    bad = rows.where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    bad = bad.orderBy(F.desc("n"), "error").limit(ERRORS).collect()
    summary["errors"] = [f"{r.path}: {r.error}" + (f" (and {r.n - 1} more files)" if r.n > 1 else "") for r in bad]
    if args.database:
        store = HistoryStore(spark, args.database)
        with JobLog(spark, f"{args.database}/jobs").running("ingest", inputs=args.inputs) as done:
            done |= {"rows": summary.get("rows_processed"), "events": store.insert_events(event_log(data, store.known()), "ingest")}
    details = report.detailed_findings(report.detected_rows(found))
    if args.findings:
        details.write.mode("errorifexists").json(args.findings)
        details = details.limit(0)
    ordered = (r.asDict(True) for r in details.orderBy("file_id", "row_idx").toLocalIterator())
    return report.FORMATTERS[args.output_format](summary, ordered)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    cfg = config.load(args.config)
    spark = session()
    if args.command == "ingest":
        with open(args.output, "w", encoding="utf-8") if args.output else contextlib.nullcontext(sys.stdout) as out:
            out.writelines(run_ingest(spark, args, cfg))
    elif args.command == "status":
        for job in JobLog(spark, f"{args.database}/jobs").latest(args.job):
            print(json.dumps(job, default=str))
    elif args.command == "stats":
        print(json.dumps(HistoryStore(spark, args.database).stats().first().asDict(), indent=2, default=str))
    elif args.command == "export-db":
        HistoryStore(spark, args.database).export(args.path)
    elif args.command == "import-db":
        print(json.dumps(HistoryStore(spark, args.database).import_(args.path), indent=2))
    else:
        words = wordlist.load_words(spark, args.words) if args.words else wordlist.builtin_words(spark, cfg.custom_passwords)
        wordlist.rainbow_table(words).write.mode("overwrite").parquet(args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
