"""Format classification and vendor hints (P1-P3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.functions.text import empty_to_null, group, matches

PRI = r"^<\d+>"
PAIR = r"\w+=\S+"
CEF_VENDOR = r"\ACEF:[^|]*\|([^|]*)\|"
LEEF_VENDOR = r"\ALEEF:[^|]*\|([^|]*)\|"


def detect_format(line: Column, json: Column) -> Column:
    """First rule that holds: cef, leef, json, syslog, kv, unknown. json: the line's
    strict object, or NULL."""
    return (
        F.when(line.startswith("CEF:"), "cef").when(line.startswith("LEEF:"), "leef").when(json.isNotNull(), "json")
        .when(matches(line, PRI), "syslog").when(matches(line, PAIR), "kv").otherwise("unknown")
    )


def vendor_hints(line: Column, fmt: Column, json: Column) -> Column:
    """Hints in rule order, each once."""
    cef = F.when(fmt == "cef", empty_to_null(F.trim(group(line, CEF_VENDOR))))
    leef = F.when(fmt == "leef", empty_to_null(F.trim(group(line, LEEF_VENDOR))))
    eve = (fmt == "json") & (F.map_contains_key(json, "event_type") | F.map_contains_key(json, "alert"))
    found = F.array(
        F.when(line.contains("%ASA-"), "cisco_asa"),
        F.when(line.contains("devname="), "fortigate"),
        F.when(line.contains("sshd["), "sshd"),
        F.when(line.contains("PA-"), "paloalto"),
        F.concat(F.lit("cef_vendor:"), cef),
        F.when(F.lower(cef).contains("palo alto"), "paloalto"),
        F.when(F.lower(cef).contains("check point"), "checkpoint"),
        F.concat(F.lit("leef_vendor:"), leef),
        F.when(eve, "suricata"),
    )
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))
