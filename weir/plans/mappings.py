"""Vendor mappings: defaults, renames and code tables, as data."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

import yaml


@dataclass(frozen=True)
class Mapping:
    version: str = "1.0.0"
    defaults: dict[str, Any] = field(default_factory=dict)
    fields: dict[str, str] = field(default_factory=dict)
    nested: dict[str, str] = field(default_factory=dict)
    protocols: dict[str, str] = field(default_factory=dict)
    actions: dict[str, dict[str, str]] = field(default_factory=dict)


def _defaults(parser: str, fmt: str, category: str = "network", **observer: str) -> dict[str, Any]:
    return {f"observer.{k}": v for k, v in observer.items()} | {"event.category": category, "parse.format": fmt, "parse.parser": parser, "parse.status": "ok", "parse.confidence": 1.0}


def _action(name: str, outcome: str) -> dict[str, str]:
    return {"event.action": name, "event.outcome": outcome}


# Renames and code tables of the built-in vendors.
BUILT_IN = {
    "cef": Mapping(
        defaults=_defaults("cef", "cef"),
        fields={"src": "network.src_ip", "dst": "network.dst_ip", "spt": "network.src_port", "dpt": "network.dst_port", "proto": "network.transport", "act": "event.action"},
        protocols={"6": "tcp", "17": "udp"},
    ),
    "checkpoint": Mapping(
        defaults=_defaults("checkpoint", "kv", vendor="Check Point"),
        fields={"src": "network.src_ip", "dst": "network.dst_ip", "action": "event.action"},
        actions={"Drop": _action("Drop", "failure")},
    ),
    "fortigate": Mapping(
        defaults=_defaults("fortigate", "kv", vendor="Fortinet", product="FortiGate"),
        fields={"srcip": "network.src_ip", "srcport": "network.src_port", "dstip": "network.dst_ip", "dstport": "network.dst_port", "proto": "network.transport", "action": "event.action", "devname": "observer.name"},
        protocols={"6": "tcp", "17": "udp"},
        actions={"deny": _action("deny", "failure")},
    ),
    "cisco_asa": Mapping(
        defaults=_defaults("cisco_asa", "syslog", vendor="Cisco", product="ASA"),
        actions={"Built": _action("built", "success"), "Teardown": _action("teardown", "success"), "Denied": _action("denied", "failure"), "Deny": _action("deny", "failure")},
    ),
    "sshd": Mapping(
        defaults=_defaults("sshd", "syslog", category="authentication", product="sshd"),
        actions={"Failed password": _action("failed password", "failure")},
    ),
    "suricata": Mapping(
        defaults=_defaults("suricata", "json"),
        fields={"timestamp": "timestamp", "src_ip": "network.src_ip", "src_port": "network.src_port", "dest_ip": "network.dst_ip", "dest_port": "network.dst_port", "proto": "network.transport"},
        nested={"alert.action": "event.action", "alert.signature": "event.description", "alert.severity": "event.severity"},
        protocols={"UDP": "udp", "TCP": "tcp", "ICMP": "icmp"},
        actions={"allowed": _action("allowed", "success"), "blocked": _action("blocked", "failure")},
    ),
}


def load_mapping(path: str) -> Mapping:
    """A mapping from a YAML file of the same keys."""
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    return Mapping(str(raw.get("mapping_version") or ""), *[raw.get(k) or {} for k in ("defaults", "fields", "nested", "protocols", "actions")])


def load_mappings(folder: str | None = None) -> dict[str, Mapping]:
    """The built-in mappings, with those of a folder's YAML files over them by stem."""
    out = dict(BUILT_IN)
    for name in sorted(os.listdir(folder)) if folder else []:
        stem, ext = os.path.splitext(name)
        if ext == ".yaml":
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                if isinstance(raw := yaml.safe_load(f), dict) and "generator" not in raw:
                    out[stem] = load_mapping(os.path.join(folder, name))
    return out
