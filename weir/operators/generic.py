"""Heuristic fallback (G1-G12): structure, aliases, scans and a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.text import as_text, digits, empty_to_null, first_key, get, group, is_object, is_scalar, keys_of, matches, pairs, quote, quoted, strict_object, without
from weir.operators.vendors import CEF
from weir.plans.schema import parsed

# Grammars, aliases in order of priority, words and weights.
LOOSE_KV = r"(\w[\w.\-]*)=(\S+)"
LEEF = r"\ALEEF:([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
PRI = r"\A<(\d+)>\s*"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = rf"\b{OCTET}(?:\.{OCTET}){{3}}\b"
IPV6 = r"\b[0-9A-Fa-f:]{2,39}\b"
PORT = r"\b(?:port|sport|dport|spt|dpt)\D{0,3}(\d{1,5})\b"
PROTOCOL = r"\b(tcp|udp|icmp|icmpv6|sctp)\b"
ACTION = r"\b(allow(?:ed)?|accept(?:ed)?|deny|denied|drop(?:ped)?|block(?:ed)?)\b"
ISO_TIME = r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"
SYSLOG_TIME = r"\b[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b"
ALIASES = {
    "src_ip": ("src", "srcip", "src_ip", "source_ip", "saddr", "sip"),
    "dst_ip": ("dst", "dstip", "dst_ip", "destination_ip", "daddr", "dip", "dest_ip"),
    "src_port": ("spt", "srcport", "sport", "src_port"),
    "dst_port": ("dpt", "dstport", "dport", "dst_port"),
    "protocol": ("proto", "protocol", "transport", "ipproto"),
    "action": ("action", "act", "verdict", "disposition"),
    "timestamp": ("timestamp", "ts"),
}
ALLOW = ("allow", "allowed", "accept", "accepted")
DENY = ("deny", "denied", "drop", "dropped", "block", "blocked")
WEIGHTS = {"structure": "0.25", "timestamp": "0.15", "src_ip": "0.15", "dst_ip": "0.15", "port": "0.10", "protocol": "0.10", "action": "0.10"}
HINT_VENDORS = {"cisco_asa": "Cisco", "fortigate": "Fortinet", "paloalto": "Palo Alto Networks", "checkpoint": "Check Point", "sshd": "OpenSSH", "suricata": "OISF Suricata"}


def outcome(action: Column) -> Column:
    word = F.lower(action)
    return F.when(word.isin(*ALLOW), "success").when(word.isin(*DENY), "failure")


def ips(line: Column) -> Column:
    """Addresses in order of the scans, each once: IPv4 first, then runs of hex digits
    and colons with two colons or more."""
    v6 = F.filter(F.regexp_extract_all(line, F.lit("(?dU)" + IPV6), F.lit(0)), lambda x: F.length(x) - F.length(F.replace(x, F.lit(":"), F.lit(""))) >= 2)
    return F.array_distinct(F.concat(F.regexp_extract_all(line, F.lit("(?dU)" + IPV4), F.lit(0)), v6))


def scanned_time(line: Column) -> Column:
    return F.coalesce(group(line, ISO_TIME, 0), group(line, SYSLOG_TIME, 0))


def scanned_action(line: Column) -> Column:
    return F.lower(group(line, ACTION, 1, "(?idU)"))


def flatten_json(json: Column) -> Column:
    """Scalars one level deep by lower-cased key: the top level wins, then the first."""
    entries = F.map_entries(json)
    pair = lambda e: F.struct(F.lower(e["key"]).alias("key"), as_text(e["value"]).alias("value"))
    top = F.transform(F.filter(entries, lambda e: is_scalar(e["value"])), pair)
    inner = F.flatten(F.transform(F.filter(entries, lambda e: is_object(e["value"])), lambda e: F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>"))))
    nested = F.transform(F.filter(inner, lambda e: is_scalar(e["value"])), pair)
    return F.map_from_entries(F.concat(F.reverse(nested), top))


def generic(df: DataFrame, line: str, when: Column, hints: str, out: str) -> DataFrame:
    """df with the struct `out`: NULL where the fallback declines or `when` is false."""
    text = F.col(line)
    df = df.withColumn("_gj", F.when(when, strict_object(F.trim(text))))
    structure = (
        F.when(F.col("_gj").isNotNull(), "json").when(matches(text, CEF), "cef").when(matches(text, LEEF), "leef")
        .when(matches(text, LOOSE_KV), "kv").when(matches(text, PRI), "syslog").otherwise("none")
    )
    df = df.withColumn("_gs", F.when(when, structure))
    s = F.col("_gs")
    m = (
        F.when(s == "json", flatten_json(F.col("_gj")))
        .when(s == "cef", pairs(F.regexp_extract(text, "(?dU)" + CEF, 8), LOOSE_KV, lower=True))
        .when(s == "leef", pairs(F.regexp_extract(text, "(?dU)" + LEEF, 6), LOOSE_KV, lower=True))
        .when(s == "kv", pairs(text, LOOSE_KV, lower=True))
    )
    df = df.withColumn("_gm", m)
    m = F.col("_gm")
    keys = {name: first_key(m, aliases) for name, aliases in ALIASES.items()}
    value = {name: F.try_element_at(m, key) for name, key in keys.items()}
    ports = {n: digits(value[n]) for n in ("src_port", "dst_port")}
    date, time = get(m, "date"), get(m, "time")
    joined = empty_to_null(F.trim(F.concat_ws(" ", date, time)))
    paired = keys["timestamp"].isNull() & (F.length(F.concat_ws("", date, time)) > 0)
    used = keys_of(
        *[keys[n] for n in ("src_ip", "dst_ip", "protocol", "action", "timestamp")], *[F.when(p.isNotNull(), keys[n]) for n, p in ports.items()],
        F.when(paired & date.isNotNull(), "date"), F.when(paired & time.isNotNull(), "time"),
    )
    # What each field's source says: `has` even where the value is empty.
    has = {n: keys[n].isNotNull() for n in ("src_ip", "dst_ip", "protocol", "action")} | {"timestamp": keys["timestamp"].isNotNull() | paired, "port": F.coalesce(*ports.values()).isNotNull()}
    df = df.withColumn("_gk", F.when(when, F.struct(used.alias("used"), *[v.alias(f"has_{n}") for n, v in has.items()], *[value[n].alias(n) for n in ("src_ip", "dst_ip", "protocol", "action")], *[p.alias(n) for n, p in ports.items()], F.coalesce(value["timestamp"], joined).alias("timestamp"), F.when(~has["src_ip"] | ~has["dst_ip"], ips(text)).alias("ips"))))
    k = F.col("_gk")
    scan = {"timestamp": scanned_time(text), "protocol": F.lower(group(text, PROTOCOL, 1, "(?idU)")), "action": scanned_action(text), "port": group(text, PORT, 1, "(?idU)").try_cast("int")}
    at = lambda i: F.try_element_at(k["ips"], i)
    second = F.lit(2)
    got = {
        "src_ip": F.when(k["has_src_ip"], k["src_ip"]).otherwise(at(F.lit(1))),
        "dst_ip": F.when(k["has_dst_ip"], k["dst_ip"]).otherwise(at(second)),
        "timestamp": F.when(k["has_timestamp"], k["timestamp"]).otherwise(scan["timestamp"]),
        "protocol": F.when(k["has_protocol"], F.lower(k["protocol"])).otherwise(scan["protocol"]),
        "action": F.when(k["has_action"], k["action"]).otherwise(scan["action"]),
        "port": F.when(~k["has_port"], scan["port"]),
    }
    df = df.withColumn("_gf", F.when(when, F.struct(*[v.alias(n) for n, v in got.items()])))
    f = F.col("_gf")
    found = {n: k[f"has_{n}"] | f[n].isNotNull() for n in ("timestamp", "src_ip", "dst_ip", "port", "protocol", "action")}
    score = F.when(s != "none", F.lit(WEIGHTS["structure"]).cast("decimal(4,2)")).otherwise(F.lit("0").cast("decimal(4,2)"))
    for n, x in found.items():
        score = score + F.when(x, F.lit(WEIGHTS[n]).cast("decimal(4,2)")).otherwise(F.lit("0").cast("decimal(4,2)"))
    pattern = lambda n, a, b: F.when(s == "cef", empty_to_null(F.trim(group(text, CEF, a)))).when(s == "leef", empty_to_null(F.trim(group(text, LEEF, b))) if b else F.lit(None))
    named = F.filter(F.col(hints), lambda h: h.startswith("cef_vendor:") | h.startswith("leef_vendor:"))
    guess = F.filter(F.transform(F.col(hints), lambda h: F.try_element_at(F.create_map(*[F.lit(x) for p in HINT_VENDORS.items() for x in p]), h)), lambda v: v.isNotNull())
    vendor = F.coalesce(pattern("vendor", 2, 2), F.regexp_replace(F.try_element_at(named, F.lit(1)), r"\A[a-z]+_vendor:", ""), F.try_element_at(guess, F.lit(1)))
    top_used = F.transform(F.filter(F.map_entries(F.col("_gj")), lambda e: is_scalar(e["value"]) & F.array_contains(k["used"], F.lower(e["key"]))), lambda e: e["key"])
    last = F.map_values(F.map_from_entries(F.transform(F.transform(top_used, lambda x: x), lambda x: F.struct(F.lower(x).alias("a"), x.alias("b")))))
    unmapped = (
        F.when(s == "json", F.transform_values(F.map_filter(F.col("_gj"), lambda key, _: ~F.array_contains(last, key)), lambda _, v: F.to_json(v)))
        .when(s.isin("cef", "leef", "kv"), quoted(without(m, k["used"])))
        .when(s == "syslog", F.create_map(F.lit("pri"), quote(group(text, PRI))))
    )
    event = parsed(
        timestamp=f["timestamp"], observer_vendor=vendor, observer_product=pattern("product", 3, 3), network_src_ip=f["src_ip"], network_dst_ip=f["dst_ip"],
        network_src_port=k["src_port"], network_dst_port=F.coalesce(k["dst_port"], f["port"]), network_transport=f["protocol"], event_action=f["action"],
        event_category="network", event_outcome=F.coalesce(outcome(f["action"]), F.lit("unknown")), event_description=pattern("name", 6, 0),
        parse_status="partial", parse_format=F.when(s == "none", "unknown").otherwise(s), parse_parser="generic", parse_confidence=score.cast("double"),
        mapping_version="generic", unmapped=unmapped,
    )
    claim = (s != "none") | found["timestamp"] | found["src_ip"] | found["dst_ip"] | found["port"] | found["protocol"] | found["action"]
    return df.withColumn(out, F.when(when & claim, event)).drop("_gj", "_gs", "_gm", "_gk", "_gf")
