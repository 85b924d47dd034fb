"""Projection of events to OCSF-shaped records (O1-O9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.text import whole_number
from weir.functions.time import epoch_ms

# Schema version, classes, captions and severity scales.
VERSION = "1.1.0"
FINDING = (2004, "Security Finding", 2, "Findings")
AUTHENTICATION = (3002, "Authentication", 3, "Identity & Access Management")
NETWORK = (4001, "Network Activity", 4, "Network Activity")
SEVERITIES = ("Unknown", "Informational", "Low", "Medium", "High", "Critical", "Fatal")
ASA_SEVERITY = {0: 6, 1: 6, 2: 5, 3: 5, 4: 4, 5: 3, 6: 2, 7: 1}
EVE_SEVERITY = {1: 4, 2: 3, 3: 2}
CEF_UPPER = ((0, 0), (2, 1), (4, 2), (6, 3), (8, 4))  # up to: id; 5 above


def _scale(value: Column, codes: dict[int, int]) -> Column:
    out = F.lit(0)
    for code, at in codes.items():
        out = F.when(value == code, at).otherwise(out)
    return out


def severity_id(severity: Column, parser: Column) -> Column:
    value = whole_number(severity)
    cef = F.lit(5)
    for upper, at in reversed(CEF_UPPER):
        cef = F.when(value <= upper, at).otherwise(cef)
    return F.when(value.isNull(), 0).when(parser == "cisco_asa", _scale(value, ASA_SEVERITY)).when(parser == "suricata", _scale(value, EVE_SEVERITY)).when(parser == "cef", cef).otherwise(0)


def class_of(parser: Column, category: Column, part: int) -> Column:
    return F.when(parser == "suricata", FINDING[part]).when(category == "authentication", AUTHENTICATION[part]).otherwise(NETWORK[part])


def activity(status: Column, parser: Column, category: Column, outcome: Column, part: int) -> Column:
    names = {"failed": (0, "Unknown"), "finding": (1, "Create"), "logon": (1, "Logon"), "open": (1, "Open"), "fail": (4, "Fail"), "traffic": (6, "Traffic")}
    at = lambda n: F.lit(names[n][part])
    return F.when(status == "failed", at("failed")).when(parser == "suricata", at("finding")).when(category == "authentication", at("logon")).when(outcome == "success", at("open")).when(outcome == "failure", at("fail")).otherwise(at("traffic"))


def disposition(status: Column, outcome: Column, part: int) -> Column:
    names = ((0, "Unknown"), (1, "Allowed"), (2, "Blocked"))
    at = lambda n: F.lit(names[n][part])
    return F.when(status == "failed", at(0)).when(outcome == "success", at(1)).when(outcome == "failure", at(2)).otherwise(at(0))


def event_time(timestamp: Column, ingest_time: Column, year: Column) -> Column:
    return F.coalesce(epoch_ms(timestamp, year), epoch_ms(ingest_time, year), F.lit(0).cast("bigint"))


def to_ocsf(events: DataFrame, year: int | None = None) -> DataFrame:
    """One OCSF record for each event; year completes timestamps that have none and is
    the current one by default."""
    c = F.col
    y = F.lit(year) if year else F.year(F.current_timestamp())
    cls = lambda i: class_of(c("parse_parser"), c("event_category"), i)
    act = lambda i: activity(c("parse_status"), c("parse_parser"), c("event_category"), c("event_outcome"), i)
    dis = lambda i: disposition(c("parse_status"), c("event_outcome"), i)
    events = events.withColumn("_sid", severity_id(c("event_severity"), c("parse_parser")))
    return events.select(
        cls(0).alias("class_uid"), cls(1).alias("class_name"), cls(2).alias("category_uid"), cls(3).alias("category_name"),
        act(0).alias("activity_id"), act(1).alias("activity_name"), c("_sid").alias("severity_id"),
        F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), c("_sid") + 1).alias("severity"),
        event_time(c("timestamp"), c("provenance_ingest_time"), y).alias("time"), c("event_action").alias("action"),
        dis(0).alias("disposition_id"), dis(1).alias("disposition"),
        F.struct(c("network_src_ip").alias("ip"), c("network_src_port").alias("port")).alias("src_endpoint"),
        F.struct(c("network_dst_ip").alias("ip"), c("network_dst_port").alias("port")).alias("dst_endpoint"),
        F.struct(c("network_transport").alias("protocol_name")).alias("connection_info"),
        F.struct(
            F.coalesce("observer_product", F.lit("unknown")).alias("product"), F.coalesce("observer_vendor", F.lit("unknown")).alias("vendor_name"),
            F.lit(VERSION).alias("version"), c("provenance_raw_hash").alias("raw_data_hash"), c("provenance_raw_event_id").alias("raw_event_id"),
        ).alias("metadata"),
        F.coalesce("unmapped", F.create_map().cast("map<string,string>")).alias("unmapped"),
    )
