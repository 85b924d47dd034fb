"""Integrity checks (I1-I3, JN1-JN3): recomputed hashes and two-sided references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recomputed_hash() -> F.Column:
    """SHA-256 of what a raw row holds: its bytes where the text lost some, else its text."""
    b64 = F.coalesce(F.try_to_binary(F.col("raw_bytes_b64"), F.lit("base64")), F.lit(b""))
    return F.sha2(F.when(F.col("raw_text_lossy"), b64).otherwise(F.coalesce("raw_text", F.lit("")).cast("binary")), 256)


def mismatch(kind: str, raw_id: F.Column, detail: F.Column) -> list[F.Column]:
    return [F.lit(kind).alias("kind"), raw_id.alias("raw_event_id"), detail.alias("detail")]


def raw_mismatches(raw: DataFrame) -> DataFrame:
    found = raw.withColumn("again", recomputed_hash()).where(F.coalesce("raw_hash", F.lit("")) != F.col("again"))
    return found.select(*mismatch("raw_hash_mismatch", F.col("raw_event_id"), F.concat(F.lit("stored raw_hash '"), F.coalesce("raw_hash", F.lit("")), F.lit("' != recomputed '"), F.col("again"), F.lit("'"))))


def latest_raw(raw: DataFrame) -> DataFrame:
    """The last row of each id; order is by the column `seq` where there is one."""
    raw = raw.withColumn("_order", F.col("seq") if "seq" in raw.columns else F.monotonically_increasing_id())
    return raw.groupBy(F.coalesce("raw_event_id", F.lit("")).alias("raw_event_id")).agg(F.max_by("raw_hash", "_order").alias("kept_hash"))


def event_mismatches(events: DataFrame, raw: DataFrame) -> DataFrame:
    """Events without a raw row, and events whose hash differs from their raw row's."""
    e = events.select(F.coalesce("provenance_raw_event_id", F.lit("")).alias("raw_event_id"), F.coalesce("provenance_raw_hash", F.lit("")).alias("event_hash"))
    both = e.join(latest_raw(raw).withColumn("there", F.lit(True)), "raw_event_id", "left")
    kept = F.coalesce("kept_hash", F.lit(""))
    missing = both.where("there is null").select(*mismatch("missing_raw_id", F.col("raw_event_id"), F.lit("event references a raw_event_id that no raw row has")))
    differs = both.where(F.col("there") & (F.col("event_hash") != kept))
    return missing.unionByName(differs.select(*mismatch("event_hash_mismatch", F.col("raw_event_id"), F.concat(F.lit("event provenance.raw_hash '"), F.col("event_hash"), F.lit("' != raw_hash '"), kept, F.lit("'")))))


def mismatches(raw: DataFrame, events: DataFrame) -> DataFrame:
    return raw_mismatches(raw).unionByName(event_mismatches(events, raw))


def verify(raw: DataFrame, events: DataFrame, limit: int | None = None) -> dict:
    """ok, counts, and the mismatches, raw checks first."""
    found = mismatches(raw, events)
    order = F.when(F.col("kind") == "raw_hash_mismatch", 0).otherwise(1)
    rows = found.orderBy(order, "raw_event_id", "kind")
    rows = (rows.limit(limit) if limit else rows).collect()
    n = found.count() if limit else len(rows)
    return {"ok": n == 0, "raw_count": raw.count(), "event_count": events.count(), "mismatch_count": n, "mismatches": [r.asDict() for r in rows]}
