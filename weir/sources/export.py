"""Exports of OCSF records or events (K4-K8): bulk-index NDJSON, event-collector NDJSON
and Parquet. Each is a projection of the frame; nothing is sent over a network."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.text import quote
from weir.sources.jsonl import event_json, object_, ocsf_json, read_events, read_ocsf, write_lines

INDEX = "log-events"
STDOUT = "-"


def is_ocsf(df: DataFrame) -> bool:
    return "metadata" in df.columns


def source_json(df: DataFrame) -> Column:
    return ocsf_json() if is_ocsf(df) else event_json()


def doc_id(df: DataFrame) -> Column:
    """metadata.raw_event_id of OCSF records, event_id of events, NULL if empty."""
    return F.nullif(F.col("metadata.raw_event_id") if is_ocsf(df) else F.col("event_id"), F.lit(""))


def bulk_lines(df: DataFrame, index: str = INDEX) -> DataFrame:
    """Pairs of an action and a source in one value, so they stay together."""
    id_ = F.when(doc_id(df).isNotNull(), F.concat(F.lit(',"_id":'), quote(doc_id(df)))).otherwise("")
    action = F.concat(F.lit('{"index":{"_index":'), quote(F.lit(index)), id_, F.lit("}}"))
    return df.select(F.concat_ws("\n", action, source_json(df)).alias("value"))


def collector_time(ms: Column) -> Column:
    """Seconds since the epoch, NULL unless positive."""
    return F.when(ms > 0, ms / 1000)


def collector_lines(df: DataFrame, source: str = "weir", sourcetype: str = "weir:ocsf", index: str | None = None) -> DataFrame:
    """One wrapper a record; `index` and `time` only where there is one."""
    time = collector_time(F.col("time")) if "time" in df.columns else F.lit(None).cast("double")
    head = object_([("event", source_json(df)), ("source", quote(F.lit(source))), ("sourcetype", quote(F.lit(sourcetype)))] + ([("index", quote(F.lit(index)))] if index else []))
    tail = F.when(time.isNotNull(), F.concat(F.lit(',"time":'), time.cast("decimal(20,3)").cast("double").cast("decimal(20,3)").cast("string"))).otherwise("")
    return df.select(F.concat(F.regexp_replace(head, r"\}\z", ""), tail, F.lit("}")).alias("value"))


def to_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Typed records; what is unset is NULL."""
    df.write.mode(mode).parquet(path)


def export(spark: SparkSession, kind: str, source: str, output: str, index: str = INDEX, hec_source: str = "weir", sourcetype: str = "weir:ocsf", events: bool = False) -> None:
    df = read_events(spark, source).drop("seq") if events else read_ocsf(spark, source)
    if kind == "parquet":
        return to_parquet(df, output)
    lines = bulk_lines(df, index) if kind == "bulk" else collector_lines(df, hec_source, sourcetype, index)
    if output == STDOUT:
        for row in lines.toLocalIterator():  # one partition at a time
            print(row.value)
        return
    write_lines(lines, F.col("value"), output)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Export stored records")
    p.add_argument("format", choices=["bulk", "opensearch", "hec", "splunk", "parquet"])
    p.add_argument("--source-file", required=True)
    p.add_argument("--output", default=STDOUT, help="folder to write; lines go to standard output without one")
    p.add_argument("--index", default=INDEX)
    p.add_argument("--splunk-source", default="weir")
    p.add_argument("--splunk-sourcetype", default="weir:ocsf")
    p.add_argument("--events", action="store_true", help="the source holds events, not OCSF records")
    a = p.parse_args(argv)
    if a.format == "parquet" and a.output == STDOUT:
        p.error("parquet needs --output")
    kind = {"opensearch": "bulk", "splunk": "hec"}.get(a.format, a.format)
    export(SparkSession.builder.getOrCreate(), kind, a.source_file, a.output, a.index, a.splunk_source, a.splunk_sourcetype, a.events)


if __name__ == "__main__":
    main()
