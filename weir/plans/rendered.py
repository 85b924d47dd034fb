"""Log lines rendered from the table `events`: input of the registered queries.

One template serves Spark and the SQL oracles, so both parse the same bytes. Nine shapes
by event_id, and four kinds of damage on every 97th line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SRC = "'10.' || (user_id % 200) || '.' || (event_id % 250) || '.' || (event_id % 17 + 1)"
_DST = "'192.168.' || (event_id % 100) || '.' || (user_id % 250 + 1)"
_SPT = "(1024 + event_id % 50000)"
_DPT = "CASE event_id % 4 WHEN 0 THEN '22' WHEN 1 THEN '53' WHEN 2 THEN '80' ELSE '443' END"
_DENY = "CASE WHEN event_type = 'error' THEN {0} ELSE {1} END"


def _deny(a: str, b: str) -> str:
    return _DENY.format(f"'{a}'", f"'{b}'")


_ASA = f"'<' || (164 + event_id % 3) || '>' || {{M}} || ' ' || {{T}} || ' fw' || (user_id % 5) || ' : %ASA-' || (event_id % 8) || '-302013: ' || CASE event_type WHEN 'error' THEN 'Deny' WHEN 'view' THEN 'Teardown' WHEN 'click' THEN 'Denied' ELSE 'Built' END || ' outbound ' || CASE event_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END || ' connection ' || (100000 + event_id) || ' for outside:' || {_SRC} || '/' || {_SPT} || ' to inside:' || {_DST} || '/' || {_DPT} || CASE WHEN event_id % 2 = 0 THEN ' user u' || user_id ELSE '' END"
_FORTI = f"'date=' || {{D}} || ' time=' || {{T}} || ' devname=FG' || (user_id % 7) || ' proto=1 srcip=' || {_SRC} || ' srcport=' || {_SPT} || ' dstip=' || {_DST} || ' dstport=' || {_DPT} || ' proto=' || CASE event_id % 3 WHEN 0 THEN '6' WHEN 1 THEN '17' ELSE '47' END || ' policyid=' || (user_id % 30) || ' action=' || {_deny('deny', 'accept')}"
_CEF = f"'CEF:0|Palo Alto Networks|PanOS|10.1|' || (30000 + event_id % 500) || '|THREAT|' || CASE WHEN event_id % 11 = 0 THEN 'High' ELSE '' || (event_id % 11) END || '|src=' || {_SRC} || ' dst=' || {_DST} || ' spt=' || {_SPT} || ' dpt=' || {_DPT} || ' proto=' || CASE event_id % 3 WHEN 0 THEN '6' WHEN 1 THEN '17' ELSE '1' END || ' act=' || {_deny('drop', 'allow')} || ' cs1=z' || (event_id % 5)"
_EVE = f"""'{{"timestamp":"' || {{D}} || 'T' || {{T}} || '.' || (100000 + event_id % 900000) || 'Z","event_type":"alert","src_ip":"' || {_SRC} || '","src_port":' || {_SPT} || ',"dest_ip":"' || {_DST} || '","dest_port":' || {_DPT} || ',"proto":"' || CASE event_id % 4 WHEN 0 THEN 'UDP' WHEN 1 THEN 'TCP' WHEN 2 THEN 'ICMP' ELSE 'SCTP' END || '","alert":{{"action":"' || {_deny('blocked', 'allowed')} || '","signature":"Rule ' || (user_id % 9) || '","severity":' || (event_id % 4) || '}}}}'"""
_SSHD = f"'<38>' || {{M}} || ' ' || {{T}} || ' host' || (user_id % 3) || ' sshd[' || (1000 + event_id % 9000) || ']: Failed password for u' || user_id || ' from ' || {_SRC} || ' port ' || {_SPT} || CASE WHEN event_id % 2 = 0 THEN ' ssh2' ELSE '' END"
_CHECK = f"'src=' || {_SRC} || ' dst=' || {_DST} || ' action=' || {_deny('Drop', 'Accept')} || ' rule=' || (user_id % 12)"
_PARTIAL = f"'<134>' || {{M}} || ' ' || {{T}} || ' edge app[' || (event_id % 100) || ']: policy_violation saddr=' || {_SRC} || ' daddr=' || {_DST} || ' sport=' || {_SPT} || ' dport=' || {_DPT} || ' Proto=TCP verdict=' || {_deny('denied', 'accepted')} || ' zone=z' || (event_id % 3)"
_LEEF = f"'LEEF:1.0|Juniper|SRX|12.1|RT' || (event_id % 7) || '|src=' || {_SRC} || ' dst=' || {_DST} || ' spt=' || {_SPT} || ' proto=UDP ' || {_deny('blocked', 'allowed')} || ' at ' || {{D}} || ' ' || {{T}}"
_JSON = f"""'{{"ts":"' || {{D}} || 'T' || {{T}} || '","client":{{"sip":"' || {_SRC} || '"}},"dip":"' || {_DST} || '","verdict":"' || {_deny('deny', 'allow')} || '","n":' || (event_id % 5) || ',"up":true}}'"""

_SHAPES = (_ASA, _FORTI, _CEF, _EVE, _SSHD, _CHECK, _PARTIAL, _LEEF, _JSON)
_DAMAGE = (
    "substr('half a sentence about record ' || event_id || ' and no more of it', 1, 12 + CAST(event_id % 30 AS INT))",
    "'{\"sent\":\"never closed, \"by\": worker host:192.0.2.' || (event_id % 250 + 1)",
    "'Acme Gates|Barrier|7|2|SHUT|3|src=' || " + _SRC + " || ' port 9443 tcp stopped'",
    "'~~~NOISE~~~ qwrty letters without any number'",
)
LINE = "CASE WHEN event_id % 97 = 0 THEN CASE event_id % 388 " + " ".join(f"WHEN {97 * i} THEN {d}" for i, d in enumerate(_DAMAGE)) + " END ELSE CASE event_id % 9 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SHAPES)) + " END END"
SOURCE = "'events-' || (event_id % 3) || '.log'"


def _with(date: str, time: str, month: str) -> str:
    return LINE.replace("{D}", date).replace("{T}", time).replace("{M}", month)


def spark_line() -> str:
    return _with("date_format(ts, 'yyyy-MM-dd')", "date_format(ts, 'HH:mm:ss')", "date_format(ts, 'MMM dd')")


def duckdb_lines() -> str:
    """CTE body: event_id, source_file, line."""
    line = _with("strftime(ts, '%Y-%m-%d')", "strftime(ts, '%H:%M:%S')", "strftime(ts, '%b %d')")
    return f"SELECT event_id, {SOURCE} AS source_file, {line} AS line FROM events"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, source_file, line of every event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr("event_id", f"{SOURCE} AS source_file", f"{spark_line()} AS line")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df over all cores: parsing costs far more than its bytes suggest, so a table in
    fewer partitions than there are cores is dealt out by key first. Larger ones are left
    as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def records(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    from weir.sources.records import records_of

    found = lines(spark, sf_dir)
    return records_of((dealt(found, "event_id") if deal else found).withColumn("seq", F.col("event_id")))
