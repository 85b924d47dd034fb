"""Config-driven parsers (D1-D6): a config compiles to columns, never to row code."""

from __future__ import annotations

import os
import re
import warnings
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.text import digits, empty_to_null, fenced, get, group, keys_of, matches, quoted, without
from weir.functions.tokenize import CHAINS, STRUCTURED, flow_projection, tokenize
from weir.operators.generic import outcome
from weir.plans.schema import PARSED, column_of, parsed

MAX_GROUPS = 6
PORTS = ("network.src_port", "network.dst_port")
ROUTES = {"kv": "kv", "json": "json", "cef": "cef", "syslog_kv": "syslog", "rt_flow": "syslog", "mikrotik": "routeros", "regex": "unknown"}
#: No line is ever detected as routeros; lines of that shape are unknown or, with a
#: priority, syslog. Without this alias such configs would never be asked.
ROUTE_ALIASES = {"routeros": ("unknown", "syslog")}
FLOW_PROTOCOLS = {"6": "tcp", "17": "udp", "1": "icmp"}


class ConfigError(ValueError):
    """A config that cannot become a parser."""


@dataclass(frozen=True)
class DynamicConfig:
    stem: str
    vendor: str
    product: str
    mode: str | None
    field_map: dict[str, str]
    action_rules: tuple[tuple[str, str], ...] = ()
    timestamp_keys: tuple[str, ...] = ()
    category: str = "network"
    route: str = "unknown"
    line_regex: str | None = None
    groups: dict[str, int] = field(default_factory=dict)
    formats: tuple[str, ...] = ()


def numbered(pattern: str) -> tuple[str, dict[str, int]]:
    """A Python pattern with named groups as one with numbers alone, and their numbers."""
    compiled = re.compile(pattern)
    names = dict(compiled.groupindex)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{names[m[1]]}", pattern)
    return re.sub(r"\(\?P<\w+>", "(", out), names


def compile_config(raw: dict[str, Any], stem: str = "", aliases: dict[str, tuple[str, ...]] | None = None) -> DynamicConfig:
    """A config from its document; ConfigError if it can't be one."""
    mode = raw.get("mode")
    regex = raw.get("line_regex")
    legacy = mode is None and isinstance(regex, str)
    if mode not in STRUCTURED and mode != "regex" and not legacy:
        raise ConfigError(f"{stem}: unsupported mode {mode!r}")
    field_map = raw.get("field_map")
    if mode in STRUCTURED and not isinstance(field_map, dict):
        raise ConfigError(f"{stem}: field_map must be an object")
    groups: dict[str, int] = {}
    if mode not in STRUCTURED:
        if not isinstance(regex, str) or not regex.strip():
            raise ConfigError(f"{stem}: regex mode needs line_regex")
        try:
            n = re.compile(regex).groups
            regex, groups = numbered(regex)
        except re.error as e:
            raise ConfigError(f"{stem}: {e}") from e
        if mode == "regex" and n > MAX_GROUPS:
            raise ConfigError(f"{stem}: {n} capture groups; the limit is {MAX_GROUPS}")
    rules = []
    for rule in raw.get("action_rules") or []:
        if isinstance(rule, dict):
            needle = rule["match_value"] if "match_value" in rule else rule.get("match")
            if isinstance(needle, str):
                rules.append((needle, str(rule.get("action", needle))))
    keys = (raw.get("timestamp") or {}).get("keys") if isinstance(raw.get("timestamp"), dict) else None
    hint = raw.get("format_hint")
    route = hint.strip() if isinstance(hint, str) and hint.strip() else ROUTES.get(str(mode or ""), "unknown")
    formats = (ROUTE_ALIASES if aliases is None else aliases).get(route, (route,))
    fields = {t: s for t, s in (field_map or {}).items() if isinstance(t, str) and isinstance(s, str) and column_of(t) in PARSED}
    return DynamicConfig(stem, str(raw.get("vendor") or ""), str(raw.get("product") or ""), mode, fields, tuple(rules), tuple(k for k in keys or [] if isinstance(k, str)), str(raw.get("category") or "network"), route, regex if groups or mode not in STRUCTURED else None, groups, formats)


def load_configs(folder: str, aliases: dict[str, tuple[str, ...]] | None = None) -> tuple[DynamicConfig, ...]:
    """Configs of a folder's YAML files that carry a `generator`, in file-name order; a
    broken one is skipped with a warning."""
    out = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if not name.endswith(".yaml"):
            continue
        try:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                raw = yaml.safe_load(f)
            if isinstance(raw, dict) and raw.get("generator"):
                out.append(compile_config(raw, name.removesuffix(".yaml"), aliases))
        except (yaml.YAMLError, ConfigError) as e:
            warnings.warn(f"skipped {name}: {e}", stacklevel=2)
    return tuple(out)


def apply_field_map(fields: Column, field_map: dict[str, str], timestamp_keys: tuple[str, ...] = ()) -> tuple[dict[str, Column], Column]:
    """Copies of non-empty source values by target, and the array of keys used. The
    timestamp keys are joined by a space unless a mapped key gave the timestamp."""
    value = lambda k: empty_to_null(get(fields, k))
    out = {target: value(source) for target, source in field_map.items()}
    used = [F.when(value(s).isNotNull(), s) for s in field_map.values()]
    if timestamp_keys:
        mapped = out.get("timestamp", F.lit(None).cast("string"))
        joined = empty_to_null(F.concat_ws(" ", *[value(k) for k in timestamp_keys]))
        out["timestamp"] = F.coalesce(mapped, joined)
        used += [F.when(mapped.isNull() & value(k).isNotNull(), k) for k in timestamp_keys]
    return out, keys_of(*used)


def source_fields(config: DynamicConfig, line: Column, tokens: Column) -> Column:
    """Map of the fields that the config reads from a line, NULL where it has no say."""
    if config.line_regex is not None:
        pattern = r"\A(?:" + config.line_regex + ")"
        fields = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), group(line, pattern, i, "(?dU)").alias("value")) for n, i in config.groups.items()]), lambda e: e["value"].isNotNull())) if config.groups else F.create_map().cast("map<string,string>")
        return F.when(matches(line, pattern), fields)
    return flow_projection(tokens) if config.mode == "rt_flow" else F.when(tokens["mode"] == config.mode, tokens["fields"])


def build(config: DynamicConfig, fields: Column, spent: Column | None = None) -> tuple[Column, Column]:
    """PARSED struct of the config for its fields, NULL where it does not claim the line,
    and the array of keys used. `fields`, and `spent` for those keys, are columns that
    stand already: they are named once for each key, and within lambdas."""
    if config.line_regex is not None:
        claim = fields.isNotNull()
        got, used = apply_field_map(fields, config.field_map)
    else:
        got, used = apply_field_map(fields, config.field_map, config.timestamp_keys)
        wanted = list(dict.fromkeys([*config.field_map.values(), *config.timestamp_keys]))
        claim = F.coalesce(*[empty_to_null(get(fields, k)) for k in wanted]).isNotNull() if wanted else F.lit(False)
    action = got.get("event.action", F.lit(None).cast("string"))
    for needle, name in reversed(config.action_rules):
        action = F.when(got.get("event.action", F.lit(None)) == needle, name).otherwise(action)
    result = outcome(action)
    transport = got.get("network.transport", F.lit(None).cast("string"))
    if config.mode == "rt_flow":
        event = F.coalesce(get(fields, "event"), F.lit(""))
        verb = F.when(event.contains("SESSION_CREATE"), "allow").when(event.contains("SESSION_DENY"), "deny")
        protocol = get(fields, "protocol")
        for code, name in FLOW_PROTOCOLS.items():
            transport = F.when(protocol == code, name).otherwise(transport)
        used = F.concat(used, keys_of(F.when(verb.isNotNull(), "event"), F.when(protocol.isin(*FLOW_PROTOCOLS), "protocol")))
        action, result = F.coalesce(verb, action), F.coalesce(outcome(verb), result)
    elif config.mode == "mikrotik":
        chain = F.coalesce(F.lower(F.trim(get(fields, "chain"))), F.lit(""))
        is_chain = F.lower(action).isin(*CHAINS) | ((chain != "") & (F.lower(action) == chain))
        action, result = F.when(~F.coalesce(is_chain, F.lit(False)), action), F.when(~F.coalesce(is_chain, F.lit(False)), result)
        used = F.when(F.coalesce(is_chain, F.lit(False)), F.array_remove(used, "chain")).otherwise(used)
        word = F.lower(F.trim(get(fields, "action")))
        verb = F.when(word == "drop", "deny").when(word == "accept", "allow")
        used = F.concat(used, keys_of(F.when(verb.isNotNull(), "action")))
        action, result = F.coalesce(verb, action), F.coalesce(outcome(verb), result)
    values = {column_of(t): digits(v) if t in PORTS else v for t, v in got.items()}
    values |= {"event_action": action, "event_outcome": F.coalesce(result, F.lit("unknown")), "network_transport": transport}
    defaults = {"observer_vendor": config.vendor, "observer_product": config.product, "event_category": config.category}
    for name, text in defaults.items():
        values[name] = F.coalesce(values[name], F.lit(text)) if name in values else F.lit(text)
    values |= {"parse_format": F.lit(config.route or config.mode or ""), "parse_parser": F.lit(f"llm:{config.vendor or config.stem}"), "parse_status": F.lit("ok"), "parse_confidence": F.lit(1.0), "mapping_version": F.lit(""), "unmapped": quoted(without(fields, used if spent is None else spent))}
    return F.when(claim, parsed(**values)), used


def add_dynamic(df: DataFrame, text: str, configs: tuple[DynamicConfig, ...], claimed: Column, out: str) -> DataFrame:
    """df with the struct `out` of the first config that claims a line nobody claimed."""
    empty = parsed()
    none = F.when(F.lit(False), empty)
    if not configs:
        return df.withColumn(out, none)
    asked = sorted({f for c in configs for f in c.formats})
    df = df.withColumn("_open", ~claimed & F.col("fmt").isin(*asked))
    if any(c.line_regex is None for c in configs):
        df = tokenize(df, text, "_tokens", F.col("_open"))
    else:
        df = df.withColumn("_tokens", F.lit(None).cast("struct<mode:string,fields:map<string,string>>"))
    asks = [F.col("_open") & F.col("fmt").isin(*c.formats) for c in configs]
    df = fenced(df, "_fields", F.struct(*[F.when(ask, source_fields(c, F.col(text), F.col("_tokens"))).alias(f"c{i}") for i, (c, ask) in enumerate(zip(configs, asks))]))
    fields = [F.col("_fields")[f"c{i}"] for i in range(len(configs))]
    df = fenced(df, "_used", F.struct(*[F.when(f.isNotNull(), build(c, f)[1]).alias(f"c{i}") for i, (c, f) in enumerate(zip(configs, fields))]))
    tries = [F.when(ask, build(c, f, F.col("_used")[f"c{i}"])[0]) for i, (c, ask, f) in enumerate(zip(configs, asks, fields))]
    return df.withColumn(out, F.coalesce(*tries)).drop("_open", "_tokens", "_fields", "_used")
