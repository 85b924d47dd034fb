"""Batch run (E1, E2, K1, K3): a folder of logs to raw, events, ocsf and a report."""

from __future__ import annotations

import argparse
import sys

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from weir.operators.integrity import verify
from weir.operators.ocsf import to_ocsf
from weir.operators.quality import build_report, report_json
from weir.plans.normalize import event_columns, parse, raw_rows, with_identity
from weir.sources.files import write_text
from weir.sources.jsonl import event_json, ocsf_json, raw_json, read_events, read_raw, write_lines
from weir.sources.records import read_records


def stages(records: DataFrame, ingest_time: str | None = None, year: int | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """raw, events and ocsf of records."""
    identified = with_identity(records, ingest_time)
    events = event_columns(parse(identified, **options))
    return raw_rows(identified), events, to_ocsf(events, year)


def run(spark: SparkSession, source: str, target: str, ingest_time: str | None = None, year: int | None = None, ordered: bool = False, **options) -> dict:
    """Write the three outputs and quality.json under target; returns the report. Ids and
    hashes are functions of the input, so the outputs agree however often a task runs.

    Ordered, the part files of each output hold the records by file and number, and line n
    of a part is the same record in all three; that costs one shuffle of the input."""
    records = read_records(spark, source)
    if ordered:
        records = records.repartitionByRange("source_file", "seq").sortWithinPartitions("source_file", "seq").persist(StorageLevel.DISK_ONLY)
    raw, events, _ = stages(records, ingest_time, year, **options)
    events = events.persist(StorageLevel.DISK_ONLY)
    ocsf = to_ocsf(events, year)
    try:
        write_lines(raw, raw_json(), f"{target}/raw.jsonl")
        write_lines(events, event_json(), f"{target}/events.jsonl")
        write_lines(ocsf, ocsf_json(), f"{target}/ocsf.jsonl")
        report = build_report(events, year=year)
    finally:
        events.unpersist()
        if ordered:
            records.unpersist()
    write_text(spark, f"{target}/quality.json", report_json(report))
    return report


def verify_output(spark: SparkSession, target: str) -> dict:
    return verify(read_raw(spark, f"{target}/raw.jsonl"), read_events(spark, f"{target}/events.jsonl"))


#: Where onboarding puts approved configs, and where every command looks for them.
CONFIGS = "configs"


def parser_options(configs: str | None = None, mappings: str | None = None) -> dict:
    """Options of `parse` from a folder of config-driven parsers, none if it is
    missing, and one of mappings."""
    from weir.operators.dynamic import load_configs
    from weir.plans.mappings import load_mappings

    return {"dynamic": load_configs(configs) if configs else ()} | ({"mappings": load_mappings(mappings)} if mappings else {})


def main(argv: list[str] | None = None) -> None:
    """`run SOURCE TARGET`, or `verify TARGET` with exit code 1 on a mismatch."""
    p = argparse.ArgumentParser()
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run")
    r.add_argument("source")
    r.add_argument("target")
    r.add_argument("--configs", default=CONFIGS, help="folder of config-driven parsers")
    r.add_argument("--mappings", help="folder of mappings that replace the built-in ones")
    r.add_argument("--ordered", action="store_true", help="records by file and number, line-aligned over the outputs")
    sub.add_parser("verify").add_argument("target")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "run":
        run(spark, a.source, a.target, ordered=a.ordered, **parser_options(a.configs, a.mappings))
    else:
        report = verify_output(spark, a.target)
        print(report_json(report))
        sys.exit(0 if report["ok"] else 1)


if __name__ == "__main__":
    main()
