"""The records of the engine: raw rows, events and their OCSF projection.

Inside the engine an unset value is NULL and names have underscores; the sinks write
empty strings and the dotted names. The lists give both, in the order of the sinks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and order of the event's keys.
EVENT_KEYS = (
    "event_id", "timestamp", "observer.vendor", "observer.product", "observer.name", "network.src_ip", "network.src_port",
    "network.dst_ip", "network.dst_port", "network.transport", "user.name", "event.action", "event.category", "event.outcome",
    "event.severity", "event.description", "parse.status", "parse.format", "parse.parser", "parse.confidence",
    "provenance.raw_event_id", "provenance.raw_text", "provenance.raw_hash", "provenance.mapping_version",
    "provenance.ingest_time", "unmapped",
)
RAW_KEYS = ("raw_event_id", "raw_text", "raw_hash", "raw_text_lossy", "raw_bytes_b64", "source_file", "ingest_time")
OUTCOMES = ("success", "failure", "unknown")

#: What a parser fills in; everything else about an event comes from the record.
PARSED = {
    "timestamp": "string", "observer_vendor": "string", "observer_product": "string", "observer_name": "string",
    "network_src_ip": "string", "network_src_port": "int", "network_dst_ip": "string", "network_dst_port": "int",
    "network_transport": "string", "user_name": "string", "event_action": "string", "event_category": "string",
    "event_outcome": "string", "event_severity": "string", "severity_is_int": "boolean", "event_description": "string",
    "parse_status": "string", "parse_format": "string", "parse_parser": "string", "parse_confidence": "double",
    "mapping_version": "string", "unmapped": "map<string,string>",
}


def column_of(key: str) -> str:
    return key.replace(".", "_")


def parsed(**values: Column | str | float | None) -> Column:
    """Struct of PARSED; what is not given is NULL."""
    unknown = set(values) - set(PARSED)
    if unknown:
        raise KeyError(f"not a field of a parsed event: {sorted(unknown)}")
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[as_column(values.get(name)).cast(kind).alias(name) for name, kind in PARSED.items()])


def failed() -> Column:
    return parsed(parse_status="failed", parse_confidence=0.0, event_outcome="unknown")
