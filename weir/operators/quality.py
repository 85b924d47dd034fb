"""Data-quality report (A1-A5): one grouped pass for all groups and the whole."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.operators.ocsf import disposition, event_time


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(part / whole * 100, 2)).otherwise(0.0)


def core_fields(o: str = "") -> Column:
    """How many of the six core fields of an OCSF record are there."""
    c = lambda n: F.col(f"{o}{n}")
    there = [c("time") > 0, F.length(c("src_endpoint.ip")) > 0, F.length(c("dst_endpoint.ip")) > 0, F.length(c("connection_info.protocol_name")) > 0, F.length(c("action")) > 0, c("disposition") != "Unknown"]
    return sum((F.coalesce(x, F.lit(False)).cast("int") for x in there), F.lit(0))


CORE_FIELDS = 6


def grade(events: DataFrame, year: int | None = None) -> DataFrame:
    """Rows (grp, status, core, keys, seq) from events alone: what the OCSF projection
    would hold is computed in the same pass, so nothing is joined."""
    c = F.col
    y = F.lit(year) if year else F.year(F.current_timestamp())
    seen = events.withColumns({
        "time": event_time(c("timestamp"), c("provenance_ingest_time"), y), "action": c("event_action"), "disposition": disposition(c("parse_status"), c("event_outcome"), 1),
        "src_endpoint": F.struct(c("network_src_ip").alias("ip")), "dst_endpoint": F.struct(c("network_dst_ip").alias("ip")), "connection_info": F.struct(c("network_transport").alias("protocol_name")),
    })
    return seen.select(F.coalesce("observer_vendor", "source_file").alias("grp"), c("parse_status").alias("status"), core_fields().alias("core"), F.map_keys("unmapped").alias("keys"), "source_file", "seq")


def graded(events: DataFrame, ocsf: DataFrame) -> DataFrame:
    """The same rows from stored events and their stored OCSF records, joined by id."""
    o = ocsf.select(F.col("metadata.raw_event_id").alias("_id"), core_fields().alias("core"))
    e = events.select(F.col("event_id").alias("_id"), F.coalesce("observer_vendor", "source_file").alias("grp"), F.col("parse_status").alias("status"), F.map_keys("unmapped").alias("keys"), "source_file", "seq")
    return e.join(o, "_id")


def group_report(rows: DataFrame) -> DataFrame:
    """A row for each group and one, with grp NULL and overall 1, for all."""
    n = F.count(F.lit(1))
    status = lambda s: F.count_if(F.col("status") == s)
    return rows.rollup("grp").agg(
        F.grouping("grp").cast("int").alias("overall"), n.alias("total_events"),
        percent(status("ok"), n).alias("parsed_pct"), percent(status("partial"), n).alias("partial_pct"), percent(status("failed"), n).alias("failed_pct"),
        percent(F.sum("core"), n * CORE_FIELDS).alias("ocsf_core_fields_populated_pct"),
    )


def top_unmapped(rows: DataFrame, k: int = 5) -> DataFrame:
    """(overall, grp, key, count, rank): the most frequent unmapped keys, ties by first
    appearance in file and record order."""
    return _ranked(partials(rows)[1], k)


def _ranked(keys: DataFrame, k: int) -> DataFrame:
    counts = add_partials("keys", keys)
    whole = counts.groupBy("key").agg(F.sum("count").alias("count"), F.min("first").alias("first")).select(F.lit(1).alias("overall"), F.lit(None).cast("string").alias("grp"), "key", "count", "first")
    both = counts.select(F.lit(0).alias("overall"), "grp", "key", "count", "first").unionByName(whole)
    rank = F.row_number().over(Window.partitionBy("overall", "grp").orderBy(F.desc("count"), "first"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).drop("first")


def partials(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums that add up over parts of the input: by group, and by group and key."""
    status = lambda s: F.count_if(F.col("status") == s)
    groups = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), status("ok").alias("ok"), status("partial").alias("partial"), status("failed").alias("failed"), F.sum("core").alias("core"))
    keys = rows.select("grp", "source_file", "seq", F.posexplode("keys").alias("pos", "key")).groupBy("grp", "key").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("source_file", "seq", "pos")).alias("first"))
    return groups, keys


def add_partials(name: str, rows: DataFrame) -> DataFrame:
    """Partial sums of several parts, `groups` or `keys`, as those of the whole."""
    if name == "groups":
        return rows.groupBy("grp").agg(*[F.sum(c).alias(c) for c in ("n", "ok", "partial", "failed", "core")])
    return rows.groupBy("grp", "key").agg(F.sum("count").alias("count"), F.min("first").alias("first"))


def report_of(groups: DataFrame, keys: DataFrame, k: int = 5) -> dict:
    """The report from partial sums; a row for each group and k keys of each reach the driver."""
    sums = groups.rollup("grp").agg(F.grouping("grp").alias("overall"), *[F.sum(c).alias(c) for c in ("n", "ok", "partial", "failed", "core")])
    found = sums.select(
        "grp", "overall", F.col("n").alias("total_events"), percent(F.col("ok"), F.col("n")).alias("parsed_pct"), percent(F.col("partial"), F.col("n")).alias("partial_pct"),
        percent(F.col("failed"), F.col("n")).alias("failed_pct"), percent(F.col("core"), F.col("n") * CORE_FIELDS).alias("ocsf_core_fields_populated_pct"),
    ).collect()
    tops: dict[tuple, list] = {}
    for r in _ranked(keys, k).orderBy("overall", "grp", "rank").collect():
        tops.setdefault((r.overall, r.grp), []).append({"key": r.key, "count": r["count"]})
    names = ("total_events", "parsed_pct", "partial_pct", "failed_pct", "ocsf_core_fields_populated_pct")
    body = lambda r: {n: r[n] for n in names} | {"top_unmapped_keys": tops.get((r.overall, r.grp), [])}
    whole = [body(r) for r in found if r.overall and r.total_events]
    empty = dict(zip(names, (0, 0.0, 0.0, 0.0, 0.0))) | {"top_unmapped_keys": []}
    return {"generated_at": datetime.now(timezone.utc).isoformat(), "overall": whole[0] if whole else empty, "sources": {r.grp: body(r) for r in sorted((r for r in found if not r.overall), key=lambda r: r.grp or "")}}


def build_report(events: DataFrame, ocsf: DataFrame | None = None, k: int = 5, year: int | None = None) -> dict:
    """The report as a document, from events alone or with their OCSF records."""
    return report_of(*partials(grade(events, year) if ocsf is None else graded(events, ocsf)), k)


def report_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)
