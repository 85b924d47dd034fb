"""Vendor parsers (V1-V6) as structs of columns.

Each builder takes the columns of a line and gives a PARSED struct that is NULL when the
parser does not claim the line. A port that is not a number stays in `unmapped`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.text import as_text, get, groups, item, keys_of, matches, pairs, quote, quoted, whole_number, without
from weir.plans.mappings import Mapping
from weir.plans.schema import column_of, parsed

KV = r"(\w+)=(\S+)"
PORTS = ("network.src_port", "network.dst_port")

# Header and body grammars.
CEF = r"\ACEF:([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
ASA = r"\A<(\d+)>(\w+\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+:\s+%ASA-(\d+)-(\d+):\s+(.*)$"
ASA_BODY = r"\A(Built|Teardown|Denied|Deny)\s+(inbound|outbound)\s+(TCP|UDP|ICMP)\s+connection\s+(\d+)\s+for\s+[^:]+:(\d+\.\d+\.\d+\.\d+)/(\d+)\s+to\s+[^:]+:(\d+\.\d+\.\d+\.\d+)/(\d+)(?:\s+user\s+(\S+))?"
SSHD = r"\A<(\d+)>(\w+\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+sshd\[(\d+)\]:\s+(Failed password) for (\S+) from (\d+\.\d+\.\d+\.\d+) port (\d+)(?:\s+(\S+))?"


@dataclass(frozen=True)
class Line:
    """Columns of a record that parsers read, each NULL where it does not apply: the pairs
    of a kv line or a CEF extension, the JSON object, and the groups of the header
    grammars, all extracted once."""

    text: Column
    kv: Column
    json: Column
    cef: Column
    asa: Column
    body: Column
    sshd: Column


def staged(df: DataFrame, text: str) -> tuple[DataFrame, Line]:
    """df with the columns of a Line; it has `fmt` and `_json` already."""
    line, fmt = F.col(text), F.col("fmt")
    found = lambda is_, pattern, n, c=line: F.when(is_ & matches(c, pattern), groups(c, pattern, n))
    df = df.withColumns({"_cef": found(fmt == "cef", CEF, 8), "_asa": found(fmt == "syslog", ASA, 6), "_sshd": found(fmt == "syslog", SSHD, 9)})
    body = F.try_element_at("_asa", F.lit(6))
    df = df.withColumns({"_body": found(F.col("_asa").isNotNull(), ASA_BODY, 9, body), "_kv": F.when(fmt == "kv", pairs(line, KV)).when(F.col("_cef").isNotNull(), pairs(F.try_element_at("_cef", F.lit(8)), KV))})
    return df, Line(line, *[F.col(c) for c in STAGED])


STAGED = ("_kv", "_json", "_cef", "_asa", "_body", "_sshd")


@dataclass(frozen=True)
class ParserSpec:
    """A parser for one format. build(line, mapping) gives a PARSED struct or NULL."""

    name: str
    format: str
    build: Callable[[Line, Mapping], Column]


def table(codes: dict[str, str], key: Column, default: Column) -> Column:
    for code, name in codes.items():
        default = F.when(key == code, name).otherwise(default)
    return default


def with_defaults(mapping: Mapping, values: dict[str, Column], action: Column | None = None) -> Column:
    """Defaults under the extracted values; the action table over both."""
    got = {column_of(k): F.lit(v) for k, v in mapping.defaults.items()}
    for name, value in values.items():
        got[name] = F.coalesce(value, got[name]) if name in got else value
    if action is not None:
        for code, sets in mapping.actions.items():
            for key, value in sets.items():
                name = column_of(key)
                got[name] = F.when(action == code, value).otherwise(got.get(name, F.lit(None)))
    got.setdefault("event_outcome", F.lit("unknown"))
    got["mapping_version"] = F.lit(mapping.version)
    return parsed(**got)


def renamed(m: Column, mapping: Mapping) -> tuple[dict[str, Column], Column]:
    """Columns of the mapped keys of a pair map, and the array of keys they use up."""
    out: dict[str, Column] = {}
    used = []
    for key, target in mapping.fields.items():
        raw = get(m, key)
        if target in PORTS:
            value = whole_number(raw)
            used.append(F.when(value.isNotNull(), key))
        else:
            value = table(mapping.protocols, raw, raw) if target == "network.transport" else raw
            used.append(F.when(raw.isNotNull(), key))
        name = column_of(target)
        out[name] = F.coalesce(value, out[name]) if name in out else value
    return out, keys_of(*used)


def cef(line: Line, mapping: Mapping) -> Column:
    at = lambda n: F.try_element_at(line.cef, F.lit(n))
    m = line.kv
    got, used = renamed(m, mapping)
    severity = at(7)
    is_int = severity.rlike(r"\A\d+\z")
    got |= {
        "observer_vendor": at(2), "observer_product": at(3), "event_description": at(6), "severity_is_int": is_int,
        "event_severity": F.when(is_int, severity.try_cast("decimal(38,0)").cast("string")).otherwise(severity),
        "unmapped": F.map_concat(F.create_map(F.lit("version"), quote(at(1)), F.lit("device_version"), quote(at(4)), F.lit("signature_id"), quote(at(5))), quoted(without(m, used))),
    }
    return F.when(line.cef.isNotNull(), with_defaults(mapping, got))


def checkpoint(line: Line, mapping: Mapping) -> Column:
    got, used = renamed(line.kv, mapping)
    claim = F.map_contains_key(line.kv, "src") & F.map_contains_key(line.kv, "dst") & F.map_contains_key(line.kv, "action")
    return F.when(claim, with_defaults(mapping, got | {"unmapped": quoted(without(line.kv, used))}, get(line.kv, "action")))


def fortigate(line: Line, mapping: Mapping) -> Column:
    m = line.kv
    got, used = renamed(m, mapping)
    claim = F.exists(F.map_keys(m), lambda k: k.isin(*mapping.fields))
    date, time = get(m, "date"), get(m, "time")
    stamped = date.isNotNull() | time.isNotNull()
    got["timestamp"] = F.when(stamped, F.concat_ws(" ", date, time))
    used = F.when(stamped, F.concat(used, F.array(F.lit("date"), F.lit("time")))).otherwise(used)
    return F.when(claim, with_defaults(mapping, got | {"unmapped": quoted(without(m, used))}, get(m, "action")))


def cisco_asa(line: Line, mapping: Mapping) -> Column:
    head = lambda n: item(line.asa, n)
    body = lambda n: item(line.body, n)
    got = {
        "timestamp": head(2), "observer_name": head(3), "event_severity": head(4), "event_description": head(6),
        "network_src_ip": body(5), "network_src_port": body(6).try_cast("int"), "network_dst_ip": body(7), "network_dst_port": body(8).try_cast("int"),
        "network_transport": F.lower(body(3)), "user_name": body(9),
        "unmapped": F.create_map(F.lit("connection_id"), quote(body(4)), F.lit("direction"), quote(body(2)), F.lit("message_id"), quote(head(5)), F.lit("pri"), quote(head(1))),
    }
    return F.when(line.body.isNotNull(), with_defaults(mapping, got, body(1)))


def sshd(line: Line, mapping: Mapping) -> Column:
    at = lambda n: item(line.sshd, n)
    got = {
        "timestamp": at(2), "observer_name": at(3), "user_name": at(6), "network_src_ip": at(7), "network_dst_port": at(8).try_cast("int"),
        "event_description": F.regexp_replace(line.text, r"(?s)\A.*?: ", ""),
        "unmapped": F.create_map(F.lit("pid"), quote(at(4)), F.lit("pri"), quote(at(1)), F.lit("method"), quote(F.coalesce(at(9), F.lit("")))),
    }
    return F.when(line.sshd.isNotNull(), with_defaults(mapping, got, at(5)))


def suricata(line: Line, mapping: Mapping) -> Column:
    at = lambda path: F.try_variant_get(get(line.json, path.split(".")[0]), "$" + path[len(path.split(".")[0]) :], "variant")
    got: dict[str, Column] = {}
    for path, target in (*mapping.fields.items(), *mapping.nested.items()):
        v = at(path)
        text = as_text(v)
        value = whole_number(F.regexp_replace(text, r"\.\d*\z", "")) if target in (*PORTS, "event.severity") else table(mapping.protocols, text, F.lower(text)) if target == "network.transport" else text
        name = column_of(target)
        got[name] = F.coalesce(value, got[name]) if name in got else value
    signature = at("alert.signature")
    got["event_severity"] = got["event_severity"].cast("string")
    got["severity_is_int"] = got["event_severity"].isNotNull()
    got["event_description"] = F.coalesce(got["event_description"], as_text(signature))
    extra = F.array(
        F.when(F.map_contains_key(line.json, "event_type"), F.struct(F.lit("event_type").alias("k"), F.to_json(get(line.json, "event_type")).alias("v"))),
        F.when(signature.isNotNull() & ~F.is_variant_null(signature), F.struct(F.lit("signature").alias("k"), F.to_json(signature).alias("v"))),
    )
    got["unmapped"] = F.map_from_entries(F.filter(extra, lambda x: x.isNotNull()))
    claim = F.map_contains_key(line.json, "event_type") | F.map_contains_key(line.json, "alert")
    return F.when(claim, with_defaults(mapping, got, as_text(at("alert.action"))))


#: In order of first refusal within a format.
VENDORS = (
    ParserSpec("cef", "cef", cef), ParserSpec("checkpoint", "kv", checkpoint), ParserSpec("cisco_asa", "syslog", cisco_asa),
    ParserSpec("fortigate", "kv", fortigate), ParserSpec("sshd", "syslog", sshd), ParserSpec("suricata", "json", suricata),
)
