"""Records to events: one narrow plan for batch and streams (P1-P9)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.text import empty_to_null, fenced, strict_object
from weir.operators.detect import detect_format, vendor_hints
from weir.operators.dynamic import DynamicConfig, add_dynamic
from weir.operators.generic import generic
from weir.operators.vendors import STAGED, VENDORS, ParserSpec, staged
from weir.plans.mappings import BUILT_IN, Mapping
from weir.plans.schema import EVENT_KEYS, OUTCOMES, PARSED, column_of, failed
from weir.session import configure


def uuid_of(*parts: Column) -> Column:
    """A UUID-shaped id that is the same on every evaluation."""
    h = F.sha2(F.concat_ws("\0", *parts), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def with_identity(records: DataFrame, ingest_time: str | None = None) -> DataFrame:
    """Raw vault columns: id, exact hash, base-64 bytes where the text lost some."""
    stamp = ingest_time or datetime.now(timezone.utc).isoformat()
    df = records.withColumn("raw_hash", F.sha2("raw_bytes", 256))
    df = df.withColumn("raw_event_id", uuid_of(F.col("source_file"), F.col("seq").cast("string"), F.col("raw_hash")))
    return df.withColumns({"raw_bytes_b64": F.when(F.col("raw_text_lossy"), F.base64("raw_bytes")).otherwise(""), "ingest_time": F.lit(stamp)})


def raw_rows(df: DataFrame) -> DataFrame:
    return df.select("raw_event_id", "raw_text", "raw_hash", "raw_text_lossy", "raw_bytes_b64", "source_file", "ingest_time")


def parse(df: DataFrame, text: str = "raw_text", mappings: dict[str, Mapping] | None = None, parsers: tuple[ParserSpec, ...] = VENDORS, dynamic: tuple[DynamicConfig, ...] = ()) -> DataFrame:
    """df with `fmt`, `hints` (where no parser claims the line) and the struct `parsed`: the first parser of the line's
    format that claims it, dynamic configs after the built-in ones, then the fallback,
    then a failed event. Each step is a projection; nothing moves between rows."""
    configure(df.sparkSession)
    mappings = BUILT_IN | (mappings or {})
    line = F.col(text)
    df = df.withColumn("_json", F.when(line.startswith("{"), strict_object(line)))
    df = df.withColumn("fmt", detect_format(line, F.col("_json")))
    df, cols = staged(df, text)
    branches: dict[str, list[Column]] = {}
    for spec in parsers:
        branches.setdefault(spec.format, []).append(spec.build(cols, mappings.get(spec.name, Mapping())))
    chain = [F.when(F.col("fmt") == fmt, F.coalesce(*built)) for fmt, built in branches.items()]
    df = df.withColumn("_vendor", F.coalesce(*chain) if chain else F.when(F.lit(False), failed()))
    df = add_dynamic(df, text, dynamic, claimed=F.col("_vendor").isNotNull(), out="_dynamic")
    taken = F.coalesce(F.col("_vendor"), F.col("_dynamic"))
    df = df.withColumn("_taken", taken)
    df = df.withColumn("hints", F.when(F.col("_taken").isNull(), vendor_hints(line, F.col("fmt"), F.col("_json"))))
    df = generic(df, text, F.col("_taken").isNull(), "hints", "_generic")
    return fenced(df, "parsed", F.coalesce("_taken", "_generic", failed())).drop(*STAGED, "_vendor", "_dynamic", "_taken", "_generic")


def event_columns(df: DataFrame) -> DataFrame:
    """The event row of each parsed record, in the order of the sinks, and where it came
    from: source_file, seq and severity_is_int are not part of the event."""
    p = lambda n: F.col("parsed")[n]
    got = {n: p(n) if PARSED[n] != "string" else empty_to_null(p(n)) for n in PARSED if n != "mapping_version"}
    got["event_outcome"] = F.when(p("event_outcome").isin(*OUTCOMES), p("event_outcome")).otherwise("unknown")
    got |= {"event_id": F.col("raw_event_id"), "provenance_raw_event_id": F.col("raw_event_id"), "provenance_raw_text": F.col("raw_text"), "provenance_raw_hash": F.col("raw_hash"), "provenance_mapping_version": p("mapping_version"), "provenance_ingest_time": F.col("ingest_time")}
    return df.select(*[got[column_of(k)].alias(column_of(k)) for k in EVENT_KEYS], got["severity_is_int"].alias("severity_is_int"), "source_file", "seq")


def normalize(records: DataFrame, ingest_time: str | None = None, **options) -> DataFrame:
    """Events of records: the transform that batch runs and streams share."""
    return event_columns(parse(with_identity(records, ingest_time), **options))
