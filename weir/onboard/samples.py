"""Sample lines as a frame and what is measured on it (S11, T10-T13, A8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.functions.text import group, matches, strict_object
from weir.functions.tokenize import STRUCTURED, flow_projection, strip, tokenize
from weir.operators.detect import detect_format
from weir.operators.dynamic import DynamicConfig, apply_field_map
from weir.operators.generic import ACTION, ISO_TIME, SYSLOG_TIME, ips
from weir.session import configure

EXAMPLE_CHARS = 40
#: What a line plainly holds, and the field that should then be filled.
REQUIRED = {"src_ip": "network.src_ip", "dst_ip": "network.dst_ip", "timestamp": "timestamp", "action": "event.action"}


def sample_frame(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(seq, line) of the lines that are not blank, stripped."""
    configure(spark)
    kept = [(i, s.strip()) for i, s in enumerate(lines) if s.strip()]
    return spark.createDataFrame(kept, "seq bigint, line string")


def read_samples(spark: SparkSession, path: str) -> list[str]:
    df = spark.read.option("lineSep", "\n").text(path).select(strip(F.col("value")).alias("line"))
    return [r.line for r in df.where("line <> ''").collect()]


def tokenized(lines: DataFrame) -> DataFrame:
    """Lines with tokens and the route of each."""
    df = tokenize(lines, "line", "tokens")
    fmt = detect_format(F.col("line"), F.when(F.col("line").startswith("{"), strict_object(F.col("line"))))
    return df.withColumn("fmt", fmt).withColumn("route", F.when((F.col("fmt") == "unknown") & (F.col("tokens.mode") == "mikrotik"), "routeros").otherwise(F.col("fmt")))


def mode_votes(lines: DataFrame) -> DataFrame:
    """(mode, votes), winner first: most votes, structured before regex, first seen."""
    votes = lines.groupBy(F.col("tokens.mode").alias("mode")).agg(F.count(F.lit(1)).alias("votes"), F.min("seq").alias("first"))
    return votes.orderBy(F.desc("votes"), (F.col("mode") == "regex").cast("int"), "first").select("mode", "votes")


def mode_of(lines: DataFrame) -> str:
    top = mode_votes(lines).first()
    return top.mode if top else "regex"


def route_of(lines: DataFrame) -> str:
    """The format that most lines are detected as; the first seen of equals."""
    top = lines.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").first()
    return top.route if top else "unknown"


def field_rows(lines: DataFrame, mode: str) -> DataFrame:
    return lines.where(F.col("tokens.mode") == mode).select("seq", F.posexplode(F.map_entries("tokens.fields")).alias("pos", "e")).select("seq", "pos", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def keys_of_mode(lines: DataFrame, mode: str) -> DataFrame:
    """(key) in order of first appearance."""
    return field_rows(lines, mode).groupBy("key").agg(F.min(F.struct("seq", "pos")).alias("first")).orderBy("first").select("key")


def example_values(lines: DataFrame, mode: str, limit: int = 2) -> dict[str, list[str]]:
    """Up to `limit` distinct short values of each key, first seen first."""
    text = F.translate("value", "\n\r", "  ")
    short = F.when(F.length(text) <= EXAMPLE_CHARS, text).otherwise(F.concat(F.substring(text, 1, EXAMPLE_CHARS - 3), F.lit("...")))
    distinct = field_rows(lines, mode).withColumn("short", short).groupBy("key", "short").agg(F.min(F.struct("seq", "pos")).alias("first"))
    ranked = distinct.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("first"))).where(F.col("n") <= limit)
    out: dict[str, list[str]] = {}
    for r in ranked.orderBy("first").collect():
        out.setdefault(r.key, []).append(r.short)
    order = {r.key: i for i, r in enumerate(keys_of_mode(lines, mode).collect())}
    return dict(sorted(out.items(), key=lambda kv: order[kv[0]]))


def required_fields(line: Column) -> Column:
    """Array of the fields that an independent scan says the line should fill."""
    address = F.size(ips(line)) > 0
    has = {"src_ip": address, "dst_ip": address, "timestamp": matches(line, ISO_TIME) | matches(line, SYSLOG_TIME), "action": matches(line, ACTION, "(?idU)")}
    return F.filter(F.array(*[F.when(h, REQUIRED[k]) for k, h in has.items()]), lambda x: x.isNotNull())


def source_fields(config: DynamicConfig) -> Column:
    """Source keys of a tokenized line under the config's mode, NULL if it has none."""
    tokens = F.col("tokens")
    if config.line_regex is not None:
        pattern = r"\A(?:" + config.line_regex + ")"
        items = [F.struct(F.lit(n).alias("key"), group(F.col("line"), pattern, i).alias("value")) for n, i in config.groups.items()]
        fields = F.map_from_entries(F.filter(F.array(*items), lambda e: e["value"].isNotNull())) if items else F.create_map().cast("map<string,string>")
        return F.when(matches(F.col("line"), pattern), fields)
    if config.mode == "rt_flow":
        return flow_projection(tokens)
    if config.mode not in STRUCTURED:
        return F.lit(None).cast("map<string,string>")
    return F.when((tokens["mode"] == config.mode) & (F.size(tokens["fields"]) > 0), tokens["fields"])


def coverage(lines: DataFrame, config: DynamicConfig) -> DataFrame:
    """(seq, line, matched, extracted, required, missing) of each sample line."""
    df = lines.withColumn("fields", source_fields(config))
    got, _ = apply_field_map(F.col("fields"), config.field_map, config.timestamp_keys)
    items = [F.struct(F.lit(t).alias("key"), v.alias("value")) for t, v in got.items()]
    extracted = F.map_from_entries(F.filter(F.array(*items), lambda e: e["value"].isNotNull())) if items else F.create_map().cast("map<string,string>")
    df = df.withColumn("matched", F.col("fields").isNotNull()).withColumn("extracted", F.when(F.col("matched"), extracted))
    df = df.withColumn("required", F.when(F.col("matched"), required_fields(F.col("line"))).otherwise(F.array().cast("array<string>")))
    missing = F.array_sort(F.filter("required", lambda f: ~F.map_contains_key(F.col("extracted"), f)))
    return df.select("seq", "line", "matched", "extracted", "required", missing.alias("missing"))


def rates(covered: DataFrame) -> DataFrame:
    """match_rate, required_field_rate and score in one row."""
    n, hit = F.count(F.lit(1)), F.count_if("matched")
    need = F.coalesce(F.sum(F.size("required")), F.lit(0))
    lack = F.coalesce(F.sum(F.size("missing")), F.lit(0))
    match = F.when(n > 0, hit / n).otherwise(0.0)
    required = F.when(need > 0, (need - lack) / need).otherwise(1.0)
    return covered.agg(match.alias("match_rate"), required.alias("required_field_rate"), F.bround(match * 0.6 + required * 0.4, 4).alias("score"))
