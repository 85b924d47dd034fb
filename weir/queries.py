"""Registered queries of the log operators, and the SQL they are held against.

All of them run over every row of the table `events`, rendered as log lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.time import epoch_ms
from weir.functions.text import fenced, get, pairs, strict_object
from weir.functions.tokenize import flatten_object, quoted_pairs, split_header, strip, tokenize
from weir.operators import explore, integrity, ocsf, quality
from weir.operators.detect import detect_format, vendor_hints
from weir.operators.dynamic import apply_field_map, compile_config
from weir.operators.generic import ips, outcome, scanned_action, scanned_time
from weir.operators.vendors import KV
from weir.plans import oracle as O
from weir.plans.normalize import normalize, with_identity
from weir.plans import rendered
from weir.plans.rendered import dealt, lines
from weir.session import configure
from weir.sources.export import bulk_lines, collector_lines, collector_time, doc_id
from weir.sources.records import finish, frame_lines, records_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(configure(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered.records(spark, sf_dir, deal=True)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(records(spark, sf_dir), O.INGEST).withColumnRenamed("seq", "n")


def parsed_by(parser: str, *columns: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = normalize(records(spark, sf_dir), O.INGEST)
        return df.where(F.col("parse_parser") == parser).select(F.col("seq").alias("event_id"), *[F.col(c).alias(NAMES[c]) for c in columns])

    return run


NAMES = {
    "timestamp": "ts", "observer_vendor": "vendor", "observer_product": "product", "observer_name": "name", "network_src_ip": "src_ip", "network_src_port": "src_port",
    "network_dst_ip": "dst_ip", "network_dst_port": "dst_port", "network_transport": "transport", "user_name": "user_name", "event_action": "action",
    "event_category": "category", "event_outcome": "outcome", "event_severity": "severity", "event_description": "description", "parse_status": "status",
    "parse_format": "format", "parse_parser": "parser", "parse_confidence": "confidence",
}
CORE = ("network_src_ip", "network_dst_ip", "network_src_port", "network_dst_port", "network_transport", "event_action", "event_outcome")
for name, parser, columns in (
    ("parse_cef", "cef", (*CORE, "observer_vendor", "observer_product", "event_severity", "event_description")),
    ("parse_checkpoint", "checkpoint", (*CORE, "observer_vendor")),
    ("parse_fortigate", "fortigate", (*CORE, "observer_vendor", "observer_name", "timestamp")),
    ("parse_asa", "cisco_asa", (*CORE, "observer_name", "user_name", "event_severity", "event_description", "timestamp")),
    ("parse_sshd", "sshd", (*CORE, "observer_name", "user_name", "event_category", "event_description", "timestamp")),
    ("parse_eve_json", "suricata", (*CORE, "event_severity", "event_description", "timestamp")),
    ("parse_generic", "generic", (*CORE, "observer_vendor", "observer_product", "timestamp", "parse_format", "parse_confidence")),
):
    run = parsed_by(parser, *columns)
    run.__name__ = name
    query(f"{O.EVENTS} SELECT event_id, {', '.join(NAMES[c] for c in columns)} FROM e WHERE parser = '{parser}'")(run)


@query(f"{O.FMT} SELECT event_id, fmt FROM f")
def detect(spark, sf_dir):
    line = F.col("line")
    return lines(spark, sf_dir).select("event_id", detect_format(line, F.when(line.startswith("{"), strict_object(line))).alias("fmt"))


@query(
    O.FMT + r""" SELECT event_id, concat_ws(',', CASE WHEN contains(line, '%ASA-') THEN 'cisco_asa' END, CASE WHEN contains(line, 'devname=') THEN 'fortigate' END,
    CASE WHEN contains(line, 'sshd[') THEN 'sshd' END, CASE WHEN contains(line, 'PA-') THEN 'paloalto' END,
    CASE WHEN fmt = 'cef' THEN 'cef_vendor:' || nullif(trim(regexp_extract(line, '^CEF:[^|]*\|([^|]*)\|', 1)), '') END,
    CASE WHEN fmt = 'cef' AND contains(lower(regexp_extract(line, '^CEF:[^|]*\|([^|]*)\|', 1)), 'palo alto') AND NOT contains(line, 'PA-') THEN 'paloalto' END,
    CASE WHEN fmt = 'leef' THEN 'leef_vendor:' || nullif(trim(regexp_extract(line, '^LEEF:[^|]*\|([^|]*)\|', 1)), '') END,
    CASE WHEN fmt = 'json' AND (json_exists(line, '$.event_type') OR json_exists(line, '$.alert')) THEN 'suricata' END) AS hints FROM f"""
)
def hints(spark, sf_dir):
    line = F.col("line")
    df = lines(spark, sf_dir).withColumn("json", F.when(line.startswith("{"), strict_object(line)))
    df = df.withColumn("fmt", detect_format(line, F.col("json")))
    return df.select("event_id", F.array_join(vendor_hints(line, F.col("fmt"), F.col("json")), ",").alias("hints"))


@query(f"{O.FMT} SELECT event_id, CAST(len(list_distinct(k)) AS INTEGER) AS n_keys, {O._kv('proto')} AS proto, {O._kv('srcip')} AS srcip, {O._kv('src')} AS src FROM f")
def kv_extract(spark, sf_dir):
    df = lines(spark, sf_dir).withColumn("m", pairs(F.col("line"), KV))
    return df.select("event_id", F.size("m").alias("n_keys"), *[get(F.col("m"), k).alias(k) for k in ("proto", "srcip", "src")])


@query(rf"""SELECT doc_id, ips[1] AS first_ip, list_filter(ips, lambda x: x <> ips[1])[1] AS second_ip FROM (
  SELECT doc_id, list_concat(regexp_extract_all(text, '{O._IP4}'), list_filter(regexp_extract_all(text, '\b[0-9A-Fa-f:]{{2,39}}\b'), lambda x: len(x) - len(replace(x, ':', '')) >= 2)) AS ips
  FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS text FROM documents))""")
def generic_ips(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("text"))
    found = docs.select("doc_id", ips(F.col("text")).alias("ips"))
    return found.select("doc_id", F.try_element_at("ips", F.lit(1)).alias("first_ip"), F.try_element_at("ips", F.lit(2)).alias("second_ip"))


@query(f"{O.CLAIM} SELECT event_id, s_ts AS ts, s_act AS action, CASE WHEN s_act LIKE 'a%' THEN 'success' WHEN s_act IS NOT NULL THEN 'failure' END AS outcome FROM i")
def generic_scans(spark, sf_dir):
    line = F.col("line")
    df = lines(spark, sf_dir).select("event_id", scanned_time(line).alias("ts"), scanned_action(line).alias("action"))
    return df.withColumn("outcome", outcome(F.col("action")))


@query(f"{O.EVENTS} SELECT event_id, status, parser, format, confidence FROM e")
def dispatch_status(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("n").alias("event_id"), *[F.col(c).alias(NAMES[c]) for c in ("parse_status", "parse_parser", "parse_format", "parse_confidence")])


def ocsf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = normalize(records(spark, sf_dir), O.INGEST)
    c = F.col
    return e.select(
        c("seq").alias("event_id"), *[ocsf.class_of(c("parse_parser"), c("event_category"), i).alias(n) for i, n in enumerate(("class_uid", "class_name", "category_uid", "category_name"))],
        *[ocsf.activity(c("parse_status"), c("parse_parser"), c("event_category"), c("event_outcome"), i).alias(n) for i, n in enumerate(("activity_id", "activity_name"))],
        *[ocsf.disposition(c("parse_status"), c("event_outcome"), i).alias(n) for i, n in enumerate(("disposition_id", "disposition"))],
        ocsf.severity_id(c("event_severity"), c("parse_parser")).alias("severity_id"), ocsf.event_time(c("timestamp"), c("provenance_ingest_time"), F.lit(O.YEAR)).alias("time_ms"),
    )


@query(f"{O.OCSF} SELECT event_id, class_uid, CASE class_uid WHEN 2004 THEN 'Security Finding' WHEN 3002 THEN 'Authentication' ELSE 'Network Activity' END AS class_name, CAST(class_uid // 1000 AS INTEGER) AS category_uid FROM o")
def ocsf_class(spark, sf_dir):
    return ocsf_rows(spark, sf_dir).select("event_id", "class_uid", "class_name", "category_uid")


@query(f"{O.OCSF} SELECT event_id, activity_id, CASE WHEN activity_id = 1 AND class_uid = 2004 THEN 'Create' WHEN activity_id = 1 AND class_uid = 3002 THEN 'Logon' ELSE CASE activity_id WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Open' WHEN 4 THEN 'Fail' ELSE 'Traffic' END END AS activity_name FROM o")
def ocsf_activity(spark, sf_dir):
    return ocsf_rows(spark, sf_dir).select("event_id", "activity_id", "activity_name")


@query(f"{O.OCSF} SELECT event_id, CASE disposition WHEN 'Allowed' THEN 1 WHEN 'Blocked' THEN 2 ELSE 0 END AS disposition_id, disposition FROM o")
def ocsf_disposition(spark, sf_dir):
    return ocsf_rows(spark, sf_dir).select("event_id", "disposition_id", "disposition")


@query(f"{O.OCSF} SELECT event_id, severity_id FROM o")
def ocsf_severity(spark, sf_dir):
    return ocsf_rows(spark, sf_dir).select("event_id", "severity_id")


@query(f"{O.OCSF} SELECT event_id, time_ms FROM o")
def ocsf_time(spark, sf_dir):
    return ocsf_rows(spark, sf_dir).select("event_id", "time_ms")


@query(f"""{O.OCSF} SELECT class_uid, activity_id, severity_id, time_ms AS time, action, disposition, src_ip, src_port, dst_ip, dst_port, transport AS protocol_name,
  coalesce(product, 'unknown') AS product, coalesce(vendor, 'unknown') AS vendor_name, sha256(line) AS raw_data_hash FROM o""")
def ocsf_flat(spark, sf_dir):
    o = ocsf.to_ocsf(normalize(records(spark, sf_dir), O.INGEST), O.YEAR)
    return o.select(
        "class_uid", "activity_id", "severity_id", "time", "action", "disposition", F.col("src_endpoint.ip").alias("src_ip"), F.col("src_endpoint.port").alias("src_port"), F.col("dst_endpoint.ip").alias("dst_ip"), F.col("dst_endpoint.port").alias("dst_port"),
        "connection_info.protocol_name", "metadata.product", "metadata.vendor_name", "metadata.raw_data_hash",
    )


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the quality report, graded in the same pass that parses them."""
    return quality.grade(normalize(records(spark, sf_dir), O.INGEST), O.YEAR)


_PCT = "round_even({0} / count(*) * 100, 2)"
_GROUP = "count(*) AS total_events, " + ", ".join(f"{_PCT.format(f'count(*) FILTER (status = {s!r})')} AS {n}_pct" for s, n in (("ok", "parsed"), ("partial", "partial"), ("failed", "failed"))) + ", round_even(CAST(sum(core) AS DOUBLE) / (count(*) * 6) * 100, 2) AS ocsf_core_fields_populated_pct"


@query(f"{O.OCSF} SELECT grp, {_GROUP} FROM q GROUP BY grp")
def quality_by_source(spark, sf_dir):
    return quality.group_report(graded(spark, sf_dir)).where("overall = 0").drop("overall")


@query(f"{O.OCSF} SELECT {_GROUP} FROM q")
def quality_overall(spark, sf_dir):
    return quality.group_report(graded(spark, sf_dir)).where("overall = 1").drop("overall", "grp")


@query(f"""{O.EVENTS}, u AS (SELECT grp, source_file, event_id, unnest(list_distinct(unmapped_keys)) AS key FROM e),
  n AS (SELECT grp, key, count(*) AS count FROM u GROUP BY ALL) SELECT * FROM n""")
def unmapped_keys(spark, sf_dir):
    """How often each group leaves each key unmapped; the order of ties is tested apart."""
    return quality.partials(graded(spark, sf_dir))[1].select("grp", "key", "count")


@query(f"""{O.EVENTS}, u AS (SELECT source_file, event_id, unmapped_keys, unnest(list_distinct(unmapped_keys)) AS key FROM e), n AS (SELECT key, count(*) AS count, min({{'f': source_file, 's': event_id, 'p': list_position(unmapped_keys, key)}}) AS seen FROM u GROUP BY key)
  SELECT CAST(row_number() OVER (ORDER BY count DESC, seen) AS INTEGER) AS rank, key, count FROM n QUALIFY rank <= 5""")
def top_unmapped_keys(spark, sf_dir):
    """The report's five most frequent unmapped keys of all events."""
    return quality.top_unmapped(graded(spark, sf_dir), 5).where("overall = 1").select("rank", "key", "count")


@query(f"{O.EVENTS} SELECT count(*) AS event_count, count(*) FILTER (status = 'failed') AS failed_parses, count(DISTINCT vendor) AS distinct_vendors, count(*) FILTER (category = 'authentication' AND outcome = 'failure') AS authentication_failures FROM e")
def viewer_summary(spark, sf_dir):
    return explore.summary(normalize(records(spark, sf_dir), O.INGEST))


@query(f"{O.EVENTS} SELECT src_ip, count(*) AS events FROM e WHERE src_ip <> '' GROUP BY src_ip ORDER BY events DESC, min({{'f': source_file, 's': event_id}}) LIMIT 5")
def top_sources(spark, sf_dir):
    """The viewer's five busiest sources."""
    return explore.top_sources(normalize(records(spark, sf_dir), O.INGEST))


@query(f"{O.EVENTS} SELECT event_id, src_ip, dst_ip FROM e WHERE contains(lower(src_ip), '10.1') OR contains(lower(dst_ip), '10.1')")
def ip_filter(spark, sf_dir):
    found = explore.filter_events(normalize(records(spark, sf_dir), O.INGEST), " 10.1 ")
    return found.select(F.col("seq").alias("event_id"), F.col("network_src_ip").alias("src_ip"), F.col("network_dst_ip").alias("dst_ip"))


@query(f"{O.LINES} SELECT event_id, sha256(line) AS raw_hash FROM lines")
def raw_hash(spark, sf_dir):
    return with_identity(records(spark, sf_dir), O.INGEST).select(F.col("seq").alias("event_id"), "raw_hash")


def tampered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw rows and event references: of every 10 raw rows one has another text, and one
    of 7 is gone; one of 9 events has another hash."""
    r = with_identity(records(spark, sf_dir), O.INGEST).withColumn("id", F.col("seq").cast("string"))
    raw = r.where("seq % 7 <> 0").select(F.col("id").alias("raw_event_id"), F.when(F.col("seq") % 10 == 0, F.concat("raw_text", F.lit("!"))).otherwise(F.col("raw_text")).alias("raw_text"), "raw_hash", "raw_text_lossy", "raw_bytes_b64", "seq")
    e = r.select(F.col("id").alias("provenance_raw_event_id"), F.when(F.col("seq") % 9 == 0, F.lit("other")).otherwise(F.col("raw_hash")).alias("provenance_raw_hash"))
    return raw, e


@query("SELECT CAST(event_id AS VARCHAR) AS raw_event_id FROM events WHERE event_id % 7 <> 0 AND event_id % 10 = 0")
def verify_hash(spark, sf_dir):
    return integrity.raw_mismatches(tampered(spark, sf_dir)[0]).select("raw_event_id")


@query("SELECT CAST(event_id AS VARCHAR) AS raw_event_id FROM events WHERE event_id % 7 = 0")
def verify_missing(spark, sf_dir):
    raw, e = tampered(spark, sf_dir)
    return integrity.event_mismatches(e, raw).where("kind = 'missing_raw_id'").select("raw_event_id")


@query("SELECT CAST(event_id AS VARCHAR) AS raw_event_id FROM events WHERE event_id % 7 <> 0 AND event_id % 9 = 0")
def verify_crosscheck(spark, sf_dir):
    raw, e = tampered(spark, sf_dir)
    return integrity.event_mismatches(e, raw).where("kind = 'event_hash_mismatch'").select("raw_event_id")


@query(f"""{O.LINES}, p AS (SELECT source_file, event_id, CASE WHEN event_id % 5 IN (1, 2) THEN ' at ' || event_id ELSE line END AS line FROM lines),
  w AS (SELECT *, sum(CASE WHEN starts_with(line, ' ') THEN 0 ELSE 1 END) OVER (PARTITION BY source_file ORDER BY event_id) AS g, min(event_id) OVER (PARTITION BY source_file) AS f FROM p),
  r AS (SELECT source_file, g, string_agg(line, chr(10) ORDER BY event_id) AS text, count(*) AS n FROM w GROUP BY source_file, g)
  SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY g) - 1 AS seq, sha256(text) AS raw_hash FROM r""")
def frame_continuations(spark, sf_dir):
    line = F.when((F.col("event_id") % 5).isin(1, 2), F.concat(F.lit(" at "), F.col("event_id").cast("string"))).otherwise(F.col("line"))
    df = lines(spark, sf_dir).select(F.col("source_file").alias("file"), F.floor(F.col("event_id") / 1000).cast("bigint").alias("split"), F.col("event_id").alias("at"), line.alias("line"))
    return frame_lines(fenced(df, "value", F.col("line")).drop("line")).select("source_file", "seq", F.sha2("raw_bytes", 256).alias("raw_hash"))


@query(f"{O.OCSF} SELECT event_id, CASE WHEN time_ms > 0 THEN time_ms / 1000 END AS time_s FROM o")
def splunk_time(spark, sf_dir):
    return ocsf_rows(spark, sf_dir).select("event_id", collector_time(F.col("time_ms")).alias("time_s"))


_ID = r"sha256(encode(source_file) || '\x00'::BLOB || encode(event_id::VARCHAR) || '\x00'::BLOB || encode(sha256(line)))"
_UUID = f"{O.LINES}, h AS (SELECT *, {_ID} AS h FROM lines), d AS (SELECT *, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS id FROM h)"


@query(f"{_UUID} SELECT id AS doc_id, sha256(line) AS raw_hash FROM d")
def bulk_doc_id(spark, sf_dir):
    """The document id of each record, made of its file, number and bytes."""
    o = ocsf.to_ocsf(normalize(records(spark, sf_dir), O.INGEST), O.YEAR)
    return o.select(doc_id(o).alias("doc_id"), F.col("metadata.raw_data_hash").alias("raw_hash"))


@query(f"""{_UUID} SELECT '{{"index":{{"_index":"log-events","_id":"' || id || '"}}}}' AS action, id AS event_id, sha256(line) AS raw_hash FROM d""")
def bulk_actions(spark, sf_dir):
    """The two lines of each record's bulk entry."""
    e = bulk_lines(normalize(records(spark, sf_dir), O.INGEST))
    both = F.split("value", "\n", 2)
    return e.select(both[0].alias("action"), *[F.get_json_object(both[1], f"$['{k}']").alias(n) for k, n in (("event_id", "event_id"), ("provenance.raw_hash", "raw_hash"))])


@query(f"{O.OCSF} SELECT sha256(line) AS raw_hash, 'weir' AS source, 'weir:ocsf' AS sourcetype, 'idx' AS index_name, time_ms / 1000 AS time_s, class_uid FROM o")
def collector_wrappers(spark, sf_dir):
    """The event-collector wrapper of each record, read back."""
    o = collector_lines(ocsf.to_ocsf(normalize(records(spark, sf_dir), O.INGEST), O.YEAR), index="idx")
    at = lambda k: F.get_json_object("value", f"$.{k}")
    return o.select(at("event.metadata.raw_data_hash").alias("raw_hash"), at("source").alias("source"), at("sourcetype").alias("sourcetype"), at("index").alias("index_name"), at("time").cast("double").alias("time_s"), at("event.class_uid").cast("int").alias("class_uid"))


@query(f"{O.EVENTS} SELECT event_id, src_ip, dst_ip, src_port FROM e")
def jsonl_round_trip(spark, sf_dir):
    """Events written as JSON text and parsed back."""
    from weir.sources.jsonl import event_json

    e = normalize(records(spark, sf_dir), O.INGEST).select("seq", event_json().alias("j"))
    at = lambda k: F.nullif(F.get_json_object("j", f"$['{k}']"), F.lit(""))
    return e.select(F.col("seq").alias("event_id"), at("network.src_ip").alias("src_ip"), at("network.dst_ip").alias("dst_ip"), at("network.src_port").try_cast("int").alias("src_port"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(dealt(lines(spark, sf_dir), "event_id"), "line", "tokens")


_HEAD = r"regexp_matches(line, '^<\d{1,3}>')"
_MODE = rf"""CASE WHEN starts_with(line, '{{') AND json_valid(line) THEN 'json' WHEN starts_with(line, 'CEF:') OR starts_with(line, 'LEEF:') THEN 'cef'
  WHEN {_HEAD} AND regexp_matches(line, '[A-Za-z_][\w.\-]*=[^\s]+') THEN 'syslog_kv'
  WHEN len(regexp_extract_all(line, '([A-Za-z_][\w.\-]*)=([^\s]+)')) >= 2 AND NOT {_HEAD} AND len(list_distinct(regexp_extract_all(line, '([A-Za-z_][\w.\-]*)=([^\s]+)', 1))) >= 2 THEN 'kv' ELSE 'regex' END"""


@query(f"{O.LINES} SELECT {_MODE} AS mode, count(*) AS votes FROM lines GROUP BY 1")
def mode_vote(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("tokens.mode").agg(F.count(F.lit(1)).alias("votes"))


@query(rf"""{O.LINES}, t AS (SELECT event_id, line, {_MODE} AS mode FROM lines),
  x AS (SELECT event_id, unnest(list_distinct(regexp_extract_all(line, '([A-Za-z_][\w.\-]*)=([^\s]+)', 1))) AS key FROM t WHERE mode = 'kv')
  SELECT key, count(*) AS n, min(event_id) AS first_event FROM x GROUP BY key""")
def token_keys(spark, sf_dir):
    kv = tokens(spark, sf_dir).where("tokens.mode = 'kv'")
    return kv.select("event_id", F.explode(F.map_keys("tokens.fields")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query(rf"""{O.FMT}, t AS (SELECT *, {_MODE} AS mode FROM f) SELECT event_id, {O._kv('srcip')} AS src_ip, {O._kv('action')} AS action, nullif(concat_ws(' ', {O._kv('date')}, {O._kv('time')}), '') AS ts FROM t WHERE mode = 'kv'""")
def field_map_apply(spark, sf_dir):
    kv = tokens(spark, sf_dir).where("tokens.mode = 'kv'")
    got, _ = apply_field_map(F.col("tokens.fields"), {"network.src_ip": "srcip", "event.action": "action"}, ("date", "time"))
    return kv.select("event_id", got["network.src_ip"].alias("src_ip"), got["event.action"].alias("action"), got["timestamp"].alias("ts"))


def of_events(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{line} AS line")


@query(rf"""{O.LINES} SELECT event_id, {O._x('^<([0-9]+)>', 1)} AS pri, {O._x('^<[0-9]+>([A-Z][a-z]{2} +[0-9]+ [0-9:]{8})', 1)} AS ts, {O._x('^<[0-9]+>[A-Z][a-z]{2} +[0-9]+ [0-9:]{8} ([^ ]+)', 1)} AS host,
  {O._x(r'^<[0-9]+>[A-Z][a-z]{2} +[0-9]+ [0-9:]{8} [^ ]+ ([^ :\[\]]+)(?:\[[0-9]+\])?:', 1)} AS app FROM lines WHERE starts_with(line, '<')""")
def syslog_header(spark, sf_dir):
    df = lines(spark, sf_dir).where(F.col("line").startswith("<"))
    head = split_header(strip(F.col("line")))[0]
    return fenced(df, "h", head).select("event_id", *[get(F.col("h"), f"syslog_{k}").alias(n) for k, n in (("pri", "pri"), ("timestamp", "ts"), ("host", "host"), ("app", "app"))])


_NESTED = """'{"a":{"b":{"c":{"d":{"e":' || event_id || ',"f":{"g":1}}}},"x":"' || event_type || '"},"l":[1,2],"t":true,"n":null,"v":' || (event_id % 7) || '.5}'"""


@query(f"SELECT event_id, event_id::VARCHAR AS deep, event_type AS x, 'True' AS t, (event_id % 7) || '.5' AS v, CAST(4 AS INTEGER) AS n_keys FROM events")
def json_flatten(spark, sf_dir):
    """Dotted keys five levels deep; lists, nulls and what lies deeper are left out."""
    m = fenced(of_events(spark, sf_dir, _NESTED), "m", flatten_object(strict_object(F.col("line"))))
    return m.select("event_id", *[get(F.col("m"), k).alias(n) for k, n in (("a.b.c.d.e", "deep"), ("a.x", "x"), ("t", "t"), ("v", "v"))], F.size("m").alias("n_keys"))


_QUOTED = """'k1="v ' || event_type || ' ' || chr(92) || '"' || user_id || chr(92) || '"" k2=' || event_id || ' k3="a' || chr(92) || 'tb" k3="c' || chr(92) || chr(92) || 'n"'"""


@query("SELECT event_id, 'v ' || event_type || ' \"' || user_id || '\"' AS k1, event_id::VARCHAR AS k2, 'c' || chr(92) || 'n' AS k3 FROM events")
def quoted_kv(spark, sf_dir):
    m = fenced(of_events(spark, sf_dir, _QUOTED), "m", quoted_pairs(F.col("line")))
    return m.select("event_id", *[get(F.col("m"), k).alias(k) for k in ("k1", "k2", "k3")])


_FLOW = "'<14>Sep  3 09:01:02 edge RT_FLOW: RT_FLOW_SESSION_' || CASE event_id % 3 WHEN 0 THEN 'CREATE: session created ' WHEN 1 THEN 'DENY: session denied ' ELSE 'CLOSE: session closed TCP FIN: ' END || '10.0.0.' || (event_id % 250) || '/' || (1024 + event_id % 9999) || '->10.1.1.1/443 ' || CASE event_id % 3 WHEN 0 THEN '0x0 svc 1.1.1.1/1->2.2.2.2/2 0x0 N/A N/A 6 p z' WHEN 1 THEN 'svc 17(0) a b' ELSE 'svc 1.1.1.1/1->2.2.2.2/2 N/A N/A 1 p' END"


@query("SELECT event_id, 'rt_flow' AS mode, '10.0.0.' || (event_id % 250) AS src_ip, (1024 + event_id % 9999)::VARCHAR AS src_port, CASE event_id % 3 WHEN 0 THEN '6' WHEN 1 THEN '17' ELSE '1' END AS protocol, CASE event_id % 3 WHEN 0 THEN 'RT_FLOW_SESSION_CREATE' WHEN 1 THEN 'RT_FLOW_SESSION_DENY' ELSE 'RT_FLOW_SESSION_CLOSE' END AS event FROM events")
def flow_lines(spark, sf_dir):
    t = tokenize(of_events(spark, sf_dir, _FLOW), "line", "tokens")
    return t.select("event_id", "tokens.mode", *[get(F.col("tokens.fields"), k).alias(k) for k in ("src_ip", "src_port", "protocol", "event")])


_ROUTER = "'sep/03 09:01:02 firewall,info ' || CASE event_id % 3 WHEN 0 THEN 'drop forward' WHEN 1 THEN 'accept input' ELSE 'forward' END || ': in:ether' || (event_id % 9) || ' out:(unknown 0), ' || CASE WHEN event_id % 2 = 0 THEN 'src-mac 02:00:00:00:00:01, ' ELSE '' END || 'proto TCP (SYN), 10.7.7.' || (event_id % 250) || ':1234->10.8.8.8:443, len ' || (user_id % 1500)"


@query("SELECT event_id, 'mikrotik' AS mode, CASE event_id % 3 WHEN 0 THEN 'drop' WHEN 1 THEN 'accept' END AS action, CASE event_id % 3 WHEN 1 THEN 'input' ELSE 'forward' END AS chain, '10.7.7.' || (event_id % 250) AS src_ip, (user_id % 1500)::VARCHAR AS length, CASE WHEN event_id % 2 = 0 THEN '02:00:00:00:00:01' END AS src_mac FROM events")
def router_lines(spark, sf_dir):
    t = tokenize(of_events(spark, sf_dir, _ROUTER), "line", "tokens")
    return t.select("event_id", "tokens.mode", *[get(F.col("tokens.fields"), k).alias(k) for k in ("action", "chain", "src_ip", "length", "src_mac")])


_RULES = {"vendor": "Z", "product": "P", "mode": "kv", "field_map": {"network.src_ip": "srcip", "network.dst_ip": "dstip"}, "action_rules": [], "timestamp": {"keys": ["date"], "format": ""}, "category": "network"}


@query(rf"""{O.FMT}, t AS (SELECT *, {_MODE} AS mode FROM f), m AS (SELECT *, mode = 'kv' AS matched FROM t),
  r AS (SELECT matched, CASE WHEN matched THEN (CASE WHEN regexp_matches(line, '{O._IP4}') OR len(list_filter(regexp_extract_all(line, '\b[0-9A-Fa-f:]{{2,39}}\b'), lambda x: len(x) - len(replace(x, ':', '')) >= 2)) > 0 THEN 2 ELSE 0 END)
      + (CASE WHEN regexp_matches(line, '{O._ISO}') OR regexp_matches(line, '{O._SYS}') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(line, '{O._WORD}') THEN 1 ELSE 0 END) ELSE 0 END AS need,
    CASE WHEN matched THEN (CASE WHEN list_contains(k, 'srcip') THEN 1 ELSE 0 END) + (CASE WHEN list_contains(k, 'dstip') THEN 1 ELSE 0 END) + (CASE WHEN list_contains(k, 'date') AND (regexp_matches(line, '{O._ISO}') OR regexp_matches(line, '{O._SYS}')) THEN 1 ELSE 0 END) ELSE 0 END AS got FROM m)
  SELECT CAST(count(*) FILTER (matched) AS DOUBLE) / count(*) AS match_rate, CAST(sum(got) AS DOUBLE) / sum(need) AS required_field_rate FROM r""")
def validator_rates(spark, sf_dir):
    from weir.onboard.samples import coverage, rates

    df = tokens(spark, sf_dir).withColumnRenamed("event_id", "seq")
    return rates(coverage(df, compile_config(_RULES))).select("match_rate", "required_field_rate")


@query(rf"""{O.FMT} SELECT event_id, {O._kv('srcip')} AS src_ip, {O._kv('action')} AS action FROM f WHERE fmt = 'kv' AND NOT list_contains(k, 'nothing') AND list_contains(k, 'policyid')""")
def dynamic_kv(spark, sf_dir):
    """A config-driven parser in place of the built-in ones."""
    config = compile_config({"vendor": "Acme", "product": "Wall", "mode": "kv", "field_map": {"network.src_ip": "srcip", "event.action": "action", "user.name": "policyid"}, "action_rules": [], "timestamp": {"keys": [], "format": ""}, "category": "network", "format_hint": "kv"})
    e = normalize(records(spark, sf_dir), O.INGEST, parsers=(), dynamic=(config,))
    return e.where("parse_parser = 'llm:Acme' and user_name is not null").select(F.col("seq").alias("event_id"), F.col("network_src_ip").alias("src_ip"), F.col("event_action").alias("action"))


@query(r"""WITH b AS (SELECT event_id, event_id % 3 = 0 AS lossy, encode('v ' || event_id) || CASE WHEN event_id % 3 = 0 THEN '\xFF'::BLOB || encode('é') ELSE ''::BLOB END AS raw FROM events)
  SELECT event_id, lossy, 'v ' || event_id || CASE WHEN lossy THEN chr(65533) || 'é' ELSE '' END AS raw_text, CASE WHEN lossy THEN base64(raw) ELSE '' END AS bytes, sha256(raw) AS raw_hash FROM b""")
def lossy_bytes(spark, sf_dir):
    """Text, kept bytes and hash of lines that are no valid UTF-8."""
    raw = F.concat(F.encode(F.concat(F.lit("v "), F.col("event_id").cast("string")), "UTF-8"), F.when(F.col("event_id") % 3 == 0, F.lit(b"\xff\xc3\xa9")).otherwise(F.lit(b"")))
    df = finish(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("f").alias("source_file"), F.col("event_id").alias("seq"), raw.alias("raw_bytes")))
    return with_identity(df, O.INGEST).select(F.col("seq").alias("event_id"), F.col("raw_text_lossy").alias("lossy"), "raw_text", F.col("raw_bytes_b64").alias("bytes"), "raw_hash")


@query("SELECT event_id, CAST(epoch_ms(date_trunc('second', ts)) - CASE event_id % 4 WHEN 0 THEN 19800000 WHEN 1 THEN -25200000 ELSE 0 END AS BIGINT) AS time_ms FROM events")
def offset_times(spark, sf_dir):
    """Times with offsets, with and without a colon."""
    text = "date_format(ts, 'yyyy-MM-dd') || 'T' || date_format(ts, 'HH:mm:ss') || CASE event_id % 4 WHEN 0 THEN '+05:30' WHEN 1 THEN '-0700' WHEN 2 THEN 'Z' ELSE '' END"
    return of_events(spark, sf_dir, text).select("event_id", epoch_ms(F.col("line"), F.lit(O.YEAR)).alias("time_ms"))


_RFC = "'<' || (event_id % 192) || '>1 2024-02-03T04:05:06' || CASE event_id % 2 WHEN 0 THEN 'Z' ELSE '+02:00' END || ' host' || (user_id % 9) || ' app ' || CASE event_id % 3 WHEN 0 THEN '-' ELSE event_id::STRING END || ' ID' || (event_id % 7) || ' - said ' || event_type"


@query("SELECT event_id, (event_id % 192)::VARCHAR AS pri, '1' AS version, '2024-02-03T04:05:06' || CASE event_id % 2 WHEN 0 THEN 'Z' ELSE '+02:00' END AS ts, 'host' || (user_id % 9) AS host, 'app' AS app, CASE WHEN event_id % 3 <> 0 THEN event_id::VARCHAR END AS procid, 'ID' || (event_id % 7) AS msgid, '- said ' || event_type AS body FROM events")
def syslog_header_5424(spark, sf_dir):
    head, body = split_header(strip(F.col("line")))
    df = fenced(of_events(spark, sf_dir, _RFC), "h", F.struct(head.alias("head"), body.alias("body")))
    return df.select("event_id", *[get(F.col("h.head"), f"syslog_{k}").alias(n) for k, n in (("pri", "pri"), ("version", "version"), ("timestamp", "ts"), ("host", "host"), ("app", "app"), ("procid", "procid"), ("msgid", "msgid"))], F.col("h.body").alias("body"))


_PREFIXED = """CASE event_id % 2 WHEN 0 THEN 'CEF:0|Ven ' || (user_id % 9) || '|Prod|1.' || (event_id % 5) || '|' || event_id || '|' || event_type || '|' || (event_id % 11) ELSE 'LEEF:1.0|Ven ' || (user_id % 9) || '|Prod|1.' || (event_id % 5) || '|' || event_id END || '|src=10.0.0.' || (event_id % 250) || ' msg="two words" n=' || user_id"""


@query("""SELECT event_id, 'cef' AS mode, CASE WHEN event_id % 2 = 0 THEN 'Ven ' || (user_id % 9) END AS cef_vendor, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR END AS cef_signature_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 11)::VARCHAR END AS cef_severity,
  CASE WHEN event_id % 2 = 1 THEN 'Ven ' || (user_id % 9) END AS leef_vendor, CASE WHEN event_id % 2 = 1 THEN event_id::VARCHAR END AS leef_event_id, '10.0.0.' || (event_id % 250) AS src, 'two words' AS msg, user_id::VARCHAR AS n FROM events""")
def prefixed_tokens(spark, sf_dir):
    """CEF and LEEF headers and their pairs as the tokenizer reads them."""
    t = tokenize(of_events(spark, sf_dir, _PREFIXED), "line", "tokens")
    return t.select("event_id", "tokens.mode", *[get(F.col("tokens.fields"), k).alias(k) for k in ("cef_vendor", "cef_signature_id", "cef_severity", "leef_vendor", "leef_event_id", "src", "msg", "n")])


_TWIN = """'<14>1 2024-02-03T04:05:06Z edge' || (user_id % 4) || ' RT_FLOW - RT_FLOW_SESSION_' || CASE event_id % 3 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'DENY' ELSE 'CLOSE' END || ' [x@1 source-address="10.0.0.' || (event_id % 250) || '" source-port="' || (1024 + event_id % 999) || '" destination-address="10.1.1.1" destination-port="443" protocol-id="' || CASE event_id % 4 WHEN 0 THEN '6' WHEN 1 THEN '17' WHEN 2 THEN '1' ELSE '47' END || '" z="q"]'"""
_FLOW_RULES = {"vendor": "Edge", "product": "Flow", "mode": "rt_flow", "field_map": {"network.src_ip": "src_ip", "network.dst_ip": "dst_ip", "network.src_port": "src_port", "network.transport": "protocol", "event.action": "event", "observer.name": "host"}, "action_rules": [], "timestamp": {"keys": [], "format": ""}, "category": "network", "format_hint": "syslog"}


@query("""SELECT event_id, '10.0.0.' || (event_id % 250) AS src_ip, CAST(1024 + event_id % 999 AS INTEGER) AS src_port, 'edge' || (user_id % 4) AS host, CASE event_id % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' WHEN 2 THEN 'icmp' ELSE '47' END AS transport,
  CASE event_id % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'deny' ELSE 'RT_FLOW_SESSION_CLOSE' END AS action, CASE event_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' ELSE 'unknown' END AS outcome, 'llm:Edge' AS parser FROM events""")
def dynamic_flow_twin(spark, sf_dir):
    """Structured-data flow lines through a config: projection, verbs and protocols."""
    return by_config(spark, sf_dir, _TWIN, _FLOW_RULES).select(F.col("seq").alias("event_id"), F.col("network_src_ip").alias("src_ip"), F.col("network_src_port").alias("src_port"), F.col("observer_name").alias("host"), F.col("network_transport").alias("transport"), F.col("event_action").alias("action"), F.col("event_outcome").alias("outcome"), F.col("parse_parser").alias("parser"))


def by_config(spark: SparkSession, sf_dir: str, line: str, config: dict) -> DataFrame:
    """Events of rendered lines that a config alone may claim."""
    df = dealt(of_events(spark, sf_dir, line), "event_id").withColumns({"source_file": F.lit("f"), "seq": F.col("event_id")})
    return normalize(records_of(df), O.INGEST, parsers=(), dynamic=(compile_config(config),))


_ROUTER_RULES = {"vendor": "Hop", "product": "Box", "mode": "mikrotik", "field_map": {"network.src_ip": "src_ip", "network.transport": "protocol", "event.action": "chain"}, "action_rules": [], "timestamp": {"keys": [], "format": ""}, "category": "network"}


@query("SELECT event_id, '10.7.7.' || (event_id % 250) AS src_ip, 'TCP' AS transport, CASE event_id % 3 WHEN 0 THEN 'deny' WHEN 1 THEN 'allow' END AS action, CASE event_id % 3 WHEN 0 THEN 'failure' WHEN 1 THEN 'success' ELSE 'unknown' END AS outcome, CASE event_id % 3 WHEN 1 THEN 'input' ELSE 'forward' END AS chain FROM events")
def dynamic_router(spark, sf_dir):
    """Router sentences through a config: a chain is no action, drop and accept are."""
    e = by_config(spark, sf_dir, _ROUTER, _ROUTER_RULES)
    return e.select(F.col("seq").alias("event_id"), F.col("network_src_ip").alias("src_ip"), F.col("network_transport").alias("transport"), F.col("event_action").alias("action"), F.col("event_outcome").alias("outcome"), F.get_json_object(F.to_json("unmapped"), "$.chain").alias("chain_json")).withColumn("chain", F.regexp_replace("chain_json", '"', "")).drop("chain_json")


_SENTENCE = "'unit ' || user_id || ' did ' || CASE event_id % 3 WHEN 0 THEN 'drop' WHEN 1 THEN 'pass' ELSE 'note' END || ' from 10.9.8.' || (event_id % 250) || CASE event_id % 5 WHEN 0 THEN '' ELSE ' port ' || (event_id % 999) END"
_SENTENCE_RULES = {"vendor": "Said", "product": "", "mode": "regex", "line_regex": r"unit (?P<who>\d+) did (?P<verb>\w+) from (?P<ip>[\d.]+)(?: port (?P<port>\d+))?", "field_map": {"user.name": "who", "event.action": "verb", "network.src_ip": "ip", "network.src_port": "port"}, "action_rules": [{"match_value": "drop", "action": "denied"}, {"match_value": "pass", "action": "allowed"}], "category": "network"}


@query("SELECT event_id, user_id::VARCHAR AS user_name, CASE event_id % 3 WHEN 0 THEN 'denied' WHEN 1 THEN 'allowed' ELSE 'note' END AS action, CASE event_id % 3 WHEN 0 THEN 'failure' WHEN 1 THEN 'success' ELSE 'unknown' END AS outcome, '10.9.8.' || (event_id % 250) AS src_ip, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 999 AS INTEGER) END AS src_port, 'ok' AS status FROM events")
def dynamic_sentence(spark, sf_dir):
    """Lines of a pattern with named groups, and action rules."""
    e = by_config(spark, sf_dir, _SENTENCE, _SENTENCE_RULES)
    return e.select(F.col("seq").alias("event_id"), "user_name", F.col("event_action").alias("action"), F.col("event_outcome").alias("outcome"), F.col("network_src_ip").alias("src_ip"), F.col("network_src_port").alias("src_port"), F.col("parse_status").alias("status"))


@query("SELECT CAST(event_id AS VARCHAR) AS raw_event_id, CASE WHEN event_id % 5 = 0 THEN 'event_hash_mismatch' END AS kind FROM events WHERE event_id % 5 = 0")
def verify_duplicates(spark, sf_dir):
    """Raw ids that occur twice: the later row is the one that counts."""
    r = with_identity(records(spark, sf_dir), O.INGEST).withColumn("id", F.col("seq").cast("string"))
    twice = r.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    changed = ((F.col("copy") == 1) & (F.col("seq") % 5 == 0)) | ((F.col("copy") == 0) & (F.col("seq") % 3 == 0))
    raw = twice.select(F.col("id").alias("raw_event_id"), F.when(changed, "other").otherwise(F.col("raw_hash")).alias("raw_hash"), (F.col("seq") * 2 + F.col("copy")).alias("seq"))
    e = r.select(F.col("id").alias("provenance_raw_event_id"), F.col("raw_hash").alias("provenance_raw_hash"))
    return integrity.event_mismatches(e, raw).select("raw_event_id", "kind")


@query(rf"""{O.LINES}, v AS (SELECT {_MODE} AS mode, count(*) AS votes, min(event_id) AS first FROM lines GROUP BY 1)
  SELECT mode, votes FROM v ORDER BY votes DESC, mode = 'regex', first LIMIT 1""")
def mode_winner(spark, sf_dir):
    """The mode most lines are in; structured ones before `regex`, then the first seen."""
    from weir.onboard.samples import mode_votes

    return mode_votes(tokens(spark, sf_dir).withColumnRenamed("event_id", "seq")).limit(1)


@query(rf"""{O.LINES}, x AS (SELECT event_id, regexp_extract(line, 'devname=(\S+)', 1) AS value FROM lines WHERE ({_MODE}) = 'kv' AND contains(line, 'devname=')),
  d AS (SELECT value, min(event_id) AS first FROM x GROUP BY value) SELECT 'devname' AS key, string_agg(value, ',' ORDER BY first) AS examples FROM (SELECT * FROM d ORDER BY first LIMIT 2)""")
def token_examples(spark, sf_dir):
    """The first two values of a key, in order of appearance."""
    from weir.onboard.samples import example_values

    got = example_values(tokens(spark, sf_dir).withColumnRenamed("event_id", "seq").where("tokens.fields['devname'] is not null"), "kv")
    return spark.createDataFrame([("devname", ",".join(got["devname"]))], "key string, examples string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality report by source over every rendered line."""
    return QUERIES["quality_by_source"](spark, sf_dir)
