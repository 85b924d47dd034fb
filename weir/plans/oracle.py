"""SQL of the registered queries for DuckDB: it parses the rendered lines on its own."""

from __future__ import annotations

import re

from weir.plans.rendered import duckdb_lines

YEAR = 2024
INGEST = "2024-01-01T00:00:00+00:00"
INGEST_MS = 1704067200000

_IP4 = r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b"
_ASA = r"^<(\d+)>(\w+\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+:\s+%ASA-(\d+)-(\d+):\s+((Built|Teardown|Denied|Deny)\s+(inbound|outbound)\s+(TCP|UDP|ICMP)\s+connection\s+(\d+)\s+for\s+[^:]+:(\d+\.\d+\.\d+\.\d+)/(\d+)\s+to\s+[^:]+:(\d+\.\d+\.\d+\.\d+)/(\d+)(?:\s+user\s+(\S+))?.*)$"
_SSHD = r"^<(\d+)>(\w+\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+sshd\[(\d+)\]:\s+(Failed password for (\S+) from (\d+\.\d+\.\d+\.\d+) port (\d+)(?:\s+(\S+))?)"
_CEF = r"^CEF:([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
_LEEF = r"^LEEF:([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"


def _x(pattern: str, n: int) -> str:
    """Group n of the pattern; every other group is made one that does not capture."""
    seen = iter(range(1, 100))
    pattern = re.sub(r"(?<!\\)\((?!\?)", lambda m: "(" if next(seen) == n else "(?:", pattern)
    n = 1
    return f"nullif(regexp_extract(line, '{pattern}', {n}), '')"


def _kv(key: str, k: str = "k", v: str = "v") -> str:
    """The last value of a key in the lists of keys and values."""
    return f"CASE WHEN list_contains({k}, '{key}') THEN {v}[len({k}) - list_position(list_reverse({k}), '{key}') + 1] END"


def _any(keys: tuple[str, ...], k: str = "gk", v: str = "gv") -> str:
    return "coalesce(" + ", ".join(_kv(x, k, v) for x in keys) + ")"


def _has(keys: tuple[str, ...], k: str = "gk") -> str:
    return "(" + " OR ".join(f"list_contains({k}, '{x}')" for x in keys) + ")"


_JS = "json_extract_string(line, '$.{}')"
_SRC = ("src", "srcip", "src_ip", "source_ip", "saddr", "sip")
_DST = ("dst", "dstip", "dst_ip", "destination_ip", "daddr", "dip", "dest_ip")
_SPT, _DPT = ("spt", "srcport", "sport", "src_port"), ("dpt", "dstport", "dport", "dst_port")
_ACT, _PRO, _TS = ("action", "act", "verdict", "disposition"), ("proto", "protocol", "transport", "ipproto"), ("timestamp", "ts")
_ISO = r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"
_SYS = r"\b[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b"
_WORD = r"(?i)\b(allow(?:ed)?|accept(?:ed)?|deny|denied|drop(?:ped)?|block(?:ed)?)\b"
_PROTO = {"6": "tcp", "17": "udp"}


def _code(c: str, table: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + f" ELSE {c} END"


LINES = f"WITH lines AS ({duckdb_lines()})"
FMT = LINES + r""", f AS (
  SELECT *, CASE WHEN starts_with(line, 'CEF:') THEN 'cef' WHEN starts_with(line, 'LEEF:') THEN 'leef'
    WHEN starts_with(line, '{') AND json_valid(line) THEN 'json' WHEN regexp_matches(line, '^<\d+>') THEN 'syslog'
    WHEN regexp_matches(line, '\w+=\S+') THEN 'kv' ELSE 'unknown' END AS fmt,
    regexp_extract_all(line, '(\w+)=(\S+)', 1) AS k, regexp_extract_all(line, '(\w+)=(\S+)', 2) AS v FROM lines)"""
CLAIM = FMT + rf""", c AS (
  SELECT *, CASE
    WHEN fmt = 'cef' AND regexp_matches(line, '{_CEF}') THEN 'cef'
    WHEN fmt = 'json' AND (json_exists(line, '$.event_type') OR json_exists(line, '$.alert')) THEN 'suricata'
    WHEN fmt = 'kv' AND list_contains(k, 'src') AND list_contains(k, 'dst') AND list_contains(k, 'action') THEN 'checkpoint'
    WHEN fmt = 'kv' AND list_has_any(k, ['srcip', 'srcport', 'dstip', 'dstport', 'proto', 'action', 'devname']) THEN 'fortigate'
    WHEN fmt = 'syslog' AND regexp_matches(line, '{_ASA}') THEN 'cisco_asa'
    WHEN fmt = 'syslog' AND regexp_matches(line, '{_SSHD}') THEN 'sshd' END AS vendor_parser,
    CASE WHEN fmt = 'json' THEN 'json' WHEN regexp_matches(line, '{_CEF}') THEN 'cef' WHEN regexp_matches(line, '{_LEEF}') THEN 'leef'
      WHEN regexp_matches(line, '(\w[\w.\-]*)=(\S+)') THEN 'kv' WHEN regexp_matches(line, '^<\d+>') THEN 'syslog' ELSE 'none' END AS structure
  FROM f)
, g0 AS (
  SELECT *, CASE WHEN structure = 'leef' THEN regexp_extract(line, '{_LEEF}', 6) ELSE line END AS body FROM c)
, g1 AS (
  SELECT *,
    CASE WHEN structure = 'json' THEN list_concat(['sip'], list_transform(json_keys(line), lambda x: lower(x))) WHEN structure IN ('kv', 'leef') THEN list_transform(regexp_extract_all(body, '(\w[\w.\-]*)=(\S+)', 1), lambda x: lower(x)) ELSE [] END AS gk,
    CASE WHEN structure = 'json' THEN list_concat([json_extract_string(line, '$.client.sip')], list_transform(json_keys(line), lambda x: json_extract_string(line, '$.' || x))) WHEN structure IN ('kv', 'leef') THEN regexp_extract_all(body, '(\w[\w.\-]*)=(\S+)', 2) ELSE [] END AS gv,
    list_concat(regexp_extract_all(line, '{_IP4}'), list_filter(regexp_extract_all(line, '\b[0-9A-Fa-f:]{{2,39}}\b'), lambda x: len(x) - len(replace(x, ':', '')) >= 2)) AS ips
  FROM g0)
, g AS (
  SELECT *,
    {_has(_SRC)} AS h_src, {_has(_DST)} AS h_dst, {_has(_ACT)} AS h_act, {_has(_PRO)} AS h_pro,
    ({_has(_TS)} OR {_has(('date', 'time'))}) AS h_ts,
    try_cast({_any(_SPT)} AS INTEGER) AS k_spt, try_cast({_any(_DPT)} AS INTEGER) AS k_dpt,
    {_any(_SRC)} AS k_src, {_any(_DST)} AS k_dst, {_any(_ACT)} AS k_act, lower({_any(_PRO)}) AS k_pro,
    coalesce({_any(_TS)}, nullif(trim(concat_ws(' ', {_kv('date', 'gk', 'gv')}, {_kv('time', 'gk', 'gv')})), '')) AS k_ts,
    ips[1] AS ip1, list_filter(ips, lambda x: x <> ips[1])[1] AS ip2,
    try_cast(nullif(regexp_extract(line, '(?i)\b(?:port|sport|dport|spt|dpt)\D{{0,3}}(\d{{1,5}})\b', 1), '') AS INTEGER) AS s_port,
    lower(nullif(regexp_extract(line, '(?i)\b(tcp|udp|icmp|icmpv6|sctp)\b', 1), '')) AS s_pro,
    lower(nullif(regexp_extract(line, '{_WORD}', 1), '')) AS s_act,
    coalesce(nullif(regexp_extract(line, '{_ISO}'), ''), nullif(regexp_extract(line, '{_SYS}'), '')) AS s_ts
  FROM g1)
, h AS (
  SELECT *,
    CASE WHEN h_src THEN k_src ELSE ip1 END AS g_src, CASE WHEN h_dst THEN k_dst ELSE ip2 END AS g_dst,
    CASE WHEN h_act THEN k_act ELSE s_act END AS g_act, CASE WHEN h_pro THEN k_pro ELSE s_pro END AS g_pro,
    CASE WHEN h_ts THEN k_ts ELSE s_ts END AS g_ts, coalesce(k_spt, k_dpt) IS NOT NULL AS h_port,
    CASE WHEN coalesce(k_spt, k_dpt) IS NULL THEN s_port END AS g_port
  FROM g)
, i AS (
  SELECT *, CAST(CASE WHEN structure <> 'none' THEN 25 ELSE 0 END + CASE WHEN g_ts IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN g_src IS NOT NULL THEN 15 ELSE 0 END
    + CASE WHEN g_dst IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN h_port OR g_port IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN g_pro IS NOT NULL THEN 10 ELSE 0 END
    + CASE WHEN g_act IS NOT NULL THEN 10 ELSE 0 END AS DOUBLE) / 100 AS g_score,
    CASE WHEN vendor_parser IS NOT NULL THEN 'ok' WHEN structure <> 'none' OR coalesce(g_ts, g_src, g_dst, g_pro, g_act) IS NOT NULL OR g_port IS NOT NULL THEN 'partial' ELSE 'failed' END AS status
  FROM h)
"""


def _by_parser(**cases: str) -> str:
    """An expression for each parser, `generic` for partial lines, NULL for failed ones."""
    generic = cases.pop("generic", "NULL")
    return "CASE " + " ".join(f"WHEN vendor_parser = '{p}' THEN {e}" for p, e in cases.items()) + f" WHEN status = 'partial' THEN {generic} END"


def _js(path: str) -> str:
    return f"json_extract_string(line, '$.{path}')"


_VERB = f"lower({_x(_ASA, 7)})"
_CEFKV = lambda key: _kv(key)
EVENTS = CLAIM + ", e0 AS (SELECT event_id, source_file, line, fmt, status, structure, g_act, " + ", ".join(
    f"{expr} AS {name}"
    for name, expr in {
        "parser": "coalesce(vendor_parser, CASE WHEN status = 'partial' THEN 'generic' END)",
        "format": _by_parser(cef="'cef'", suricata="'json'", checkpoint="'kv'", fortigate="'kv'", cisco_asa="'syslog'", sshd="'syslog'", generic="CASE WHEN structure = 'none' THEN 'unknown' ELSE structure END"),
        "vendor": _by_parser(cef=_x(_CEF, 2), checkpoint="'Check Point'", fortigate="'Fortinet'", cisco_asa="'Cisco'", generic=f"CASE WHEN structure = 'leef' THEN {_x(_LEEF, 2)} END"),
        "product": _by_parser(cef=_x(_CEF, 3), fortigate="'FortiGate'", cisco_asa="'ASA'", sshd="'sshd'", generic=f"CASE WHEN structure = 'leef' THEN {_x(_LEEF, 3)} END"),
        "name": _by_parser(fortigate=_kv("devname"), cisco_asa=_x(_ASA, 3), sshd=_x(_SSHD, 3)),
        "src_ip": _by_parser(cef=_kv("src"), suricata=_js("src_ip"), checkpoint=_kv("src"), fortigate=_kv("srcip"), cisco_asa=_x(_ASA, 11), sshd=_x(_SSHD, 7), generic="g_src"),
        "dst_ip": _by_parser(cef=_kv("dst"), suricata=_js("dest_ip"), checkpoint=_kv("dst"), fortigate=_kv("dstip"), cisco_asa=_x(_ASA, 13), generic="g_dst"),
        "src_port": _by_parser(cef=f"try_cast({_kv('spt')} AS INTEGER)", suricata=f"CAST({_js('src_port')} AS INTEGER)", fortigate=f"try_cast({_kv('srcport')} AS INTEGER)", cisco_asa=f"CAST({_x(_ASA, 12)} AS INTEGER)", generic="k_spt"),
        "dst_port": _by_parser(cef=f"try_cast({_kv('dpt')} AS INTEGER)", suricata=f"CAST({_js('dest_port')} AS INTEGER)", fortigate=f"try_cast({_kv('dstport')} AS INTEGER)", cisco_asa=f"CAST({_x(_ASA, 14)} AS INTEGER)", sshd=f"CAST({_x(_SSHD, 8)} AS INTEGER)", generic="coalesce(k_dpt, g_port)"),
        "transport": _by_parser(cef=_code(_kv("proto"), _PROTO), suricata=f"lower({_js('proto')})", fortigate=_code(_kv("proto"), _PROTO), cisco_asa=f"lower({_x(_ASA, 9)})", generic="g_pro"),
        "user_name": _by_parser(cisco_asa=_x(_ASA, 15), sshd=_x(_SSHD, 6)),
        "action": _by_parser(cef=_kv("act"), suricata=_js("alert.action"), checkpoint=_kv("action"), fortigate=_kv("action"), cisco_asa=_VERB, sshd="'failed password'", generic="g_act"),
        "category": _by_parser(cef="'network'", suricata="'network'", checkpoint="'network'", fortigate="'network'", cisco_asa="'network'", sshd="'authentication'", generic="'network'"),
        "outcome": "coalesce(" + _by_parser(
            suricata=f"CASE {_js('alert.action')} WHEN 'allowed' THEN 'success' WHEN 'blocked' THEN 'failure' END", checkpoint=f"CASE WHEN {_kv('action')} = 'Drop' THEN 'failure' END",
            fortigate=f"CASE WHEN {_kv('action')} = 'deny' THEN 'failure' END", cisco_asa=f"CASE WHEN {_VERB} IN ('built', 'teardown') THEN 'success' ELSE 'failure' END", sshd="'failure'",
            generic="CASE WHEN lower(g_act) IN ('allow', 'allowed', 'accept', 'accepted') THEN 'success' WHEN lower(g_act) IN ('deny', 'denied', 'drop', 'dropped', 'block', 'blocked') THEN 'failure' END",
        ) + ", 'unknown')",
        "severity": _by_parser(cef=_x(_CEF, 7), suricata=_js("alert.severity"), cisco_asa=_x(_ASA, 4)),
        "description": _by_parser(cef=_x(_CEF, 6), suricata=_js("alert.signature"), cisco_asa=_x(_ASA, 6), sshd=_x(_SSHD, 5)),
        "ts": _by_parser(suricata=_js("timestamp"), fortigate=f"{_kv('date')} || ' ' || {_kv('time')}", cisco_asa=_x(_ASA, 2), sshd=_x(_SSHD, 2), generic="g_ts"),
        "confidence": "CASE status WHEN 'ok' THEN 1.0::DOUBLE WHEN 'partial' THEN g_score ELSE 0.0::DOUBLE END",
        "unmapped_keys": "coalesce(" + _by_parser(
            cef="list_concat(['version', 'device_version', 'signature_id'], list_filter(k, lambda x: NOT list_contains(['src', 'dst', 'spt', 'dpt', 'proto', 'act'], x)))",
            suricata="['event_type', 'signature']", checkpoint="list_filter(k, lambda x: NOT list_contains(['src', 'dst', 'action'], x))",
            fortigate="list_filter(k, lambda x: NOT list_contains(['srcip', 'srcport', 'dstip', 'dstport', 'proto', 'action', 'devname', 'date', 'time'], x))",
            cisco_asa="['connection_id', 'direction', 'message_id', 'pri']", sshd="['pid', 'pri', 'method']",
            generic="CASE structure WHEN 'json' THEN ['client', 'n', 'up'] WHEN 'syslog' THEN ['pri'] ELSE list_filter(gk, lambda x: NOT list_contains(['src', 'saddr', 'dst', 'daddr', 'sport', 'spt', 'dport', 'dpt', 'proto', 'verdict', 'action'], x)) END",
        ) + ", [])",
    }.items()
) + " FROM i), e AS (SELECT *, coalesce(vendor, source_file) AS grp FROM e0)"

_SEV = "try_cast(severity AS INTEGER)"
OCSF = EVENTS + f""", o AS (SELECT *,
  CASE WHEN parser = 'suricata' THEN 2004 WHEN category = 'authentication' THEN 3002 ELSE 4001 END AS class_uid,
  CASE WHEN status = 'failed' THEN 0 WHEN parser = 'suricata' OR category = 'authentication' THEN 1 WHEN outcome = 'success' THEN 1 WHEN outcome = 'failure' THEN 4 ELSE 6 END AS activity_id,
  CASE WHEN status = 'failed' OR outcome = 'unknown' THEN 'Unknown' WHEN outcome = 'success' THEN 'Allowed' ELSE 'Blocked' END AS disposition,
  CASE WHEN {_SEV} IS NULL THEN 0 WHEN parser = 'cisco_asa' THEN [6, 6, 5, 5, 4, 3, 2, 1][{_SEV} + 1] WHEN parser = 'suricata' THEN CASE {_SEV} WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END
    WHEN parser = 'cef' THEN CASE WHEN {_SEV} <= 0 THEN 0 WHEN {_SEV} <= 2 THEN 1 WHEN {_SEV} <= 4 THEN 2 WHEN {_SEV} <= 6 THEN 3 WHEN {_SEV} <= 8 THEN 4 ELSE 5 END ELSE 0 END AS severity_id,
  CAST(coalesce(epoch_us(try_strptime(replace(rtrim(ts, 'Z'), 'T', ' '), ['%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S'])) // 1000, epoch_ms(try_strptime('{YEAR} ' || ts, '%Y %b %d %H:%M:%S')), {INGEST_MS}) AS BIGINT) AS time_ms
  FROM e)
, q AS (SELECT *, (CASE WHEN time_ms > 0 THEN 1 ELSE 0 END) + (CASE WHEN src_ip <> '' THEN 1 ELSE 0 END) + (CASE WHEN dst_ip <> '' THEN 1 ELSE 0 END) + (CASE WHEN transport <> '' THEN 1 ELSE 0 END) + (CASE WHEN action <> '' THEN 1 ELSE 0 END) + (CASE WHEN disposition <> 'Unknown' THEN 1 ELSE 0 END) AS core FROM o)"""
