"""Tokenizer of log lines (T1-T9): a mode and a flat map of source keys, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.text import as_text, fenced, get, group, is_object, is_scalar, matches, once, strict_object
from weir.operators.generic import LEEF
from weir.operators.vendors import CEF

MODES = ("kv", "json", "cef", "syslog_kv", "rt_flow", "mikrotik", "regex")
STRUCTURED = MODES[:-1]
FORCED = ("rt_flow", "mikrotik")

# Grammars of headers and bodies, names of their groups.
QUOTED_KV = r'([A-Za-z_][\w.\-]*)=("(?:\\.|[^"\\])*"|[^\s]+)'
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
CLOCK = r"([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
HEADERS = (
    (r"\A(?:<(\d{1,3})>)?(\d{1,3})\s+(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)$", ("pri", "version", "timestamp", "host", "app", "procid", "msgid")),
    (rf"\A(?:<(\d{{1,3}})>)?{CLOCK}\s+(\S+)\s+([^\s:\[\]]+)(?:\[(\d+)\])?:\s*(.*)$", ("pri", "timestamp", "host", "app", "procid")),
    (rf"\A(?:<(\d{{1,3}})>)?{CLOCK}\s+(\S+)\s+(.*)$", ("pri", "timestamp", "host")),
    (r"\A<(\d{1,3})>(.*)$", ("pri",)),
)
CEF_NAMES = ("version", "vendor", "product", "device_version", "signature_id", "name", "severity")
LEEF_NAMES = ("version", "vendor", "product", "device_version", "event_id")
ADDRESS = r"\d{1,3}(?:\.\d{1,3}){3}"
FLOW = rf"({ADDRESS})/(\d+)->({ADDRESS})/(\d+)"
RT_EVENT = r"RT_FLOW_SESSION_(CREATE|DENY|CLOSE)\s*:\s*session\s+(?:created|denied|closed)\b(.*)\z"
RT_TAILS = {
    "CREATE": rf"\s*{FLOW}(?:\s+\S+){{6}}\s+(\d+)\b",
    "DENY": rf"\s*{FLOW}\s+\S+\s+(\d+)\(\d+\)",
    "CLOSE": rf".*?:\s*{FLOW}(?:\s+\S+){{4}}\s+(\d+)\b",
}
ROUTER = (
    r"\A(?:<(\d{1,3})>)?((?:[A-Za-z]{3}/\d{1,2}|[A-Z][a-z]{2}\s+\d{1,2})\s+\d{2}:\d{2}:\d{2})(?:\s+((?!firewall\b)\S+))?"
    r"\s+firewall,(\w+)\s+([^:]+):\s+in:(\S+)\s+out:(.+?),\s+(?:src-mac\s+(\S+),\s+)?(?:connection-state:(.+?)\s+)?"
    rf"proto\s+([A-Za-z0-9]+)(?:\s+\(([^)]*)\))?,\s+({ADDRESS})(?::(\d+))?->({ADDRESS})(?::(\d+))?(?:,\s+NAT\s+(.+?))?,\s+len\s+(\d+)\s*$"
)
ROUTER_NAMES = ("pri", "timestamp", "host", "severity", "action", "in_if", "out_if", "src_mac", "connection_state", "protocol", "protocol_detail", "src_ip", "src_port", "dst_ip", "dst_port", "nat", "length")
VERDICTS, CHAINS = ("drop", "accept"), ("forward", "input")
DEPTH = 5


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def entries(items: dict[str, Column]) -> Column:
    """Map of the items that have a value."""
    all_ = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in items.items()])
    return F.map_from_entries(F.filter(all_, lambda e: F.length(e["value"]) > 0))


def unescape(c: Column) -> Column:
    """Backslash escapes: doubled ones are set aside first, so each pair counts once."""
    aside = "\ue000"
    out = F.replace(c, F.lit("\\\\"), F.lit(aside))
    for code, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.when(F.contains(c, F.lit("\\")), F.replace(F.regexp_replace(out, r"(?s)\\(.)", "$1"), F.lit(aside), F.lit("\\"))).otherwise(c)


def quoted_pairs(c: Column) -> Column:
    keys = F.regexp_extract_all(c, F.lit("(?dU)" + QUOTED_KV), F.lit(1))
    values = F.regexp_extract_all(c, F.lit("(?dU)" + QUOTED_KV), F.lit(2))
    bare = lambda v: F.when((F.length(v) >= 2) & v.startswith('"') & v.endswith('"'), unescape(F.substring(v, F.lit(2), F.length(v) - 2))).otherwise(v)
    return F.map_from_arrays(keys, F.transform(values, bare))


def flatten_object(json: Column) -> Column:
    """Dotted keys of nested objects, DEPTH levels deep; the first of equal keys stays."""
    level = F.transform(F.map_entries(json), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    for _ in range(DEPTH - 1):
        level = F.flatten(F.transform(level, lambda e: F.when(is_object(e["value"]), F.transform(F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>")), lambda i: F.struct(F.concat(e["key"], F.lit("."), i["key"]).alias("key"), i["value"].alias("value")))).otherwise(F.array(e))))
    scalars = F.transform(F.filter(level, lambda e: is_scalar(e["value"])), lambda e: F.struct(e["key"].alias("key"), as_text(e["value"]).alias("value")))
    return F.map_from_entries(F.reverse(scalars))


def header_and_body(text: Column) -> Column:
    """Struct of the map of the syslog header, NULL without one, and the body. Each group
    of a pattern is matched once and named often."""
    found = []
    for pattern, names in HEADERS:

        def split(g: Column) -> Column:
            at = {n: g[i] for i, n in enumerate(names)}
            ok = F.substring(at["timestamp"], 1, 3).isin(*MONTHS) if pattern.startswith(rf"\A(?:<(\d{{1,3}})>)?{CLOCK}") else F.lit(True)
            return F.when(ok, F.struct(entries({f"syslog_{n}": F.when(v != "-", v) for n, v in at.items()}).alias("header"), strip(g[len(names)]).alias("body")))

        groups = F.array(*[F.regexp_extract(text, "(?dU)" + pattern, i + 1) for i in range(len(names) + 1)])
        best = once(groups, split)
        found.append(F.when(matches(text, pattern), once(best, lambda b: F.when(F.size(b["header"]) > 0, b))))
    return F.coalesce(*found, F.struct(F.lit(None).cast("map<string,string>").alias("header"), text.alias("body")))


def split_header(text: Column) -> tuple[Column, Column]:
    """Map of the syslog header, NULL without one, and the body."""
    best = header_and_body(text)
    return best["header"], best["body"]


def flow_fields(header: Column, body: Column) -> Column:
    verb = F.upper(group(body, RT_EVENT, 1, "(?isU)"))
    tail = F.regexp_extract(body, "(?isU)" + RT_EVENT, 2)
    found = []
    for name, pattern in RT_TAILS.items():
        flags = "(?sU)" if name == "CLOSE" else "(?dU)"
        at = [group(tail, pattern, i, flags) for i in range(1, 6)]
        fields = {"src_ip": at[0], "src_port": at[1], "dst_ip": at[2], "dst_port": at[3], "event": F.lit(f"RT_FLOW_SESSION_{name}"), "protocol": at[4]}
        fields |= {n: get(header, f"syslog_{n}") for n in ("host", "timestamp", "pri")}
        found.append(F.when((verb == name) & matches(tail, pattern, flags), entries(fields)))
    return F.coalesce(*found)


def router_fields(text: Column) -> Column:
    at = {n: strip(group(text, ROUTER, i + 1)) for i, n in enumerate(ROUTER_NAMES)}
    words = F.split(F.lower(at.pop("action")), r"\s+")
    first = lambda known: F.try_element_at(F.filter(words, lambda w: w.isin(*known)), F.lit(1))
    return F.when(matches(text, ROUTER), entries(at | {"action": first(VERDICTS), "chain": first(CHAINS)}))


def header_pairs(prefix: str, names: tuple[str, ...], body: Column, pattern: str) -> Column:
    head = entries({f"{prefix}_{n}": strip(F.regexp_extract(body, "(?dU)" + pattern, i + 1)) for i, n in enumerate(names)})
    return F.when(matches(body, pattern), F.map_concat(head, quoted_pairs(F.regexp_extract(body, "(?dU)" + pattern, len(names) + 1))))


def tokenize(df: DataFrame, text: str, out: str = "tokens", when: Column | None = None) -> DataFrame:
    """df with the struct out(mode, fields); NULL where `when` is false."""
    line = strip(F.col(text))
    df = df.withColumn("_tt", line if when is None else F.when(when, line))
    df = df.withColumn("_th", header_and_body(F.col("_tt")))
    header, body = F.col("_th.header"), F.col("_th.body")
    df = df.withColumn("_tb", F.struct(
        F.when(body.startswith("{"), flatten_object(strict_object(body))).alias("json"),
        F.coalesce(header_pairs("cef", CEF_NAMES, body, CEF), header_pairs("leef", LEEF_NAMES, body, LEEF)).alias("cef"),
        quoted_pairs(body).alias("kv"),
    ))
    json, cef, kv = (F.col(f"_tb.{n}") for n in ("json", "cef", "kv"))
    df = df.withColumn("_tf", F.struct(flow_fields(header, body).alias("flow"), router_fields(F.col("_tt")).alias("router")))
    flow, router = F.col("_tf.flow"), F.col("_tf.router")
    none = F.create_map().cast("map<string,string>")
    head = F.coalesce(header, none)
    token = lambda mode, fields: F.struct(F.lit(mode).alias("mode"), fields.alias("fields"))
    picked = (
        F.when(F.length("_tt") == 0, token("regex", none)).when(json.isNotNull(), token("json", F.map_concat(head, json)))
        .when(cef.isNotNull(), token("cef", F.map_concat(head, cef))).when(header.isNotNull() & (F.size(kv) > 0), token("syslog_kv", F.map_concat(head, kv)))
        .when(header.isNull() & (F.size(kv) >= 2), token("kv", kv)).when(flow.isNotNull(), token("rt_flow", flow))
        .when(router.isNotNull(), token("mikrotik", router)).otherwise(token("regex", head))
    )
    return fenced(df, out, F.when(F.col("_tt").isNotNull(), picked)).drop("_tt", "_th", "_tb", "_tf")


def flow_projection(tokens: Column) -> Column:
    """Flow fields of a positional line, or of the structured-data form of the same event."""
    f = tokens["fields"]
    names = {"src_ip": get(f, "source-address"), "dst_ip": get(f, "destination-address"), "event": get(f, "syslog_msgid"), "src_port": get(f, "source-port"), "dst_port": get(f, "destination-port"), "protocol": F.coalesce(F.nullif(get(f, "protocol-id"), F.lit("")), get(f, "protocol"))}
    names |= {n: get(f, f"syslog_{n}") for n in ("host", "timestamp", "pri")}
    twin = (tokens["mode"] == "syslog_kv") & get(f, "syslog_msgid").startswith("RT_FLOW_SESSION_") & (F.length(names["src_ip"]) > 0) & (F.length(names["dst_ip"]) > 0)
    return F.when(tokens["mode"] == "rt_flow", f).when(twin, entries(names))
