"""Six-vendor corpus and messy lines, end to end: files, events, OCSF, report, integrity."""

from __future__ import annotations

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from weir.operators import explore, quality
from weir.operators.integrity import verify
from weir.plans import batch
from weir.plans.normalize import normalize
from weir.sources.jsonl import read_events, read_ocsf, read_raw
from weir.sources.records import frame_files, frame_lines, read_lines, read_records

INGEST = "2026-10-01T00:00:00+00:00"
# Inputs of one line a format, whose parsed fields must equal those known for them.
SIX = {
    "checkpoint.log": b"src=1.1.1.1 dst=2.2.2.2 action=Drop\n",
    "cisco.log": b"<166>Sep 27 10:30:12 fw1 : %ASA-6-302013: Built outbound TCP connection 224811914 for outside:10.0.0.1/80 to inside:192.168.10.5/53421 user jdoe\nthis is not a log\n",
    "fortigate.log": b"date=2026-09-27 time=10:31:00 devname=FG1 srcip=172.16.1.10 srcport=1234 dstip=8.8.8.8 dstport=53 proto=17 action=deny\ndate=2026-09-27 time=10:32:00 devname=FG1 srcip=203.0.113.5 srcport=41000 dstip=198.51.100.1 dstport=443 proto=6 action=deny\n",
    "paloalto.log": b"CEF:0|Palo Alto Networks|PanOS|10.1|30514|THREAT|10|src=203.0.113.5 dst=198.51.100.1 spt=34567 dpt=443 proto=6 act=alert\n",
    "sshd.log": b"<38>Sep 27 10:34:00 host sshd[9999]: Failed password for alice from 10.0.0.3 port 22 ssh2\n",
    "suricata.log": b'{"timestamp":"2026-09-27T10:33:00.123456Z","event_type":"alert","src_ip":"10.0.0.2","src_port":54321,"dest_ip":"8.8.8.8","dest_port":53,"proto":"UDP","alert":{"action":"allowed","signature":"Allowed DNS Query","severity":2}}\n',
}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    for name, data in SIX.items():
        (folder / name).write_bytes(data)
    (folder / "sub").mkdir()
    (folder / "sub" / "ignored.log").write_bytes(b"src=9.9.9.9 dst=2.2.2.2 action=Drop\n")
    return str(folder)


@pytest.fixture(scope="module")
def out(spark, corpus, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("out"))
    return target, batch.run(spark, corpus, target, INGEST, 2026)


def test_events(spark, out):
    rows = {(r.parse_parser, r.network_src_ip): r for r in read_events(spark, f"{out[0]}/events.jsonl").collect()}
    assert len(rows) == 8
    asa = rows["cisco_asa", "10.0.0.1"]
    assert (asa.network_src_port, asa.network_dst_port, asa.network_transport, asa.user_name, asa.event_severity, asa.event_outcome) == (80, 53421, "tcp", "jdoe", "6", "success")
    assert asa.unmapped == {"connection_id": '"224811914"', "direction": '"outbound"', "message_id": '"302013"', "pri": '"166"'}
    assert rows["fortigate", "203.0.113.5"].timestamp == "2026-09-27 10:32:00"
    assert rows["sshd", "10.0.0.3"].network_dst_port == 22 and rows["sshd", "10.0.0.3"].observer_vendor is None
    assert rows[None, None].parse_status == "failed" and rows[None, None].parse_confidence == 0


def test_sink_text_has_fixed_keys_and_mixed_types(spark, out):
    from weir.plans.schema import EVENT_KEYS

    rows = [json.loads(r.value) for r in spark.read.text(f"{out[0]}/events.jsonl").collect()]
    assert all(tuple(r) == EVENT_KEYS for r in rows)
    by = {r["parse.parser"]: r for r in rows}
    assert by["cef"]["event.severity"] == 10 and by["cisco_asa"]["event.severity"] == "6" and by["suricata"]["event.severity"] == 2
    assert by[""]["parse.confidence"] == 0 and by["cef"]["parse.confidence"] == 1.0 and by["checkpoint"]["network.src_port"] == ""
    assert isinstance(by["suricata"]["unmapped"], dict) and by["suricata"]["unmapped"]["signature"] == "Allowed DNS Query"


def test_ocsf(spark, out):
    rows = {r.metadata.raw_event_id: r for r in read_ocsf(spark, f"{out[0]}/ocsf.jsonl").collect()}
    events = {r.event_id: r for r in read_events(spark, f"{out[0]}/events.jsonl").collect()}
    got = {(events[i].parse_parser, events[i].network_src_ip): (r.class_uid, r.activity_id, r.disposition, r.severity_id, r.time) for i, r in rows.items()}
    ingest = 1790812800000
    assert got == {
        ("checkpoint", "1.1.1.1"): (4001, 4, "Blocked", 0, ingest), ("cisco_asa", "10.0.0.1"): (4001, 1, "Allowed", 2, 1790505012000), (None, None): (4001, 0, "Unknown", 0, ingest),
        ("fortigate", "172.16.1.10"): (4001, 4, "Blocked", 0, 1790505060000), ("fortigate", "203.0.113.5"): (4001, 4, "Blocked", 0, 1790505120000), ("cef", "203.0.113.5"): (4001, 6, "Unknown", 5, ingest),
        ("sshd", "10.0.0.3"): (3002, 1, "Blocked", 0, 1790505240000), ("suricata", "10.0.0.2"): (2004, 1, "Allowed", 3, 1790505180123),
    }
    keys = list(json.loads(spark.read.text(f"{out[0]}/ocsf.jsonl").first().value))
    assert keys[0] == "class_uid" and keys[-1] == "unmapped" and len(keys) == 17


def test_report(spark, out):
    report = out[1]
    whole = report["overall"]
    assert (whole["total_events"], whole["parsed_pct"], whole["partial_pct"], whole["failed_pct"], whole["ocsf_core_fields_populated_pct"]) == (8, 87.5, 0.0, 12.5, 81.25)
    assert whole["top_unmapped_keys"][0] == {"key": "pri", "count": 2} and len(whole["top_unmapped_keys"]) == 5
    assert list(report["sources"]) == ["Check Point", "Cisco", "Fortinet", "Palo Alto Networks", "cisco.log", "sshd.log", "suricata.log"]
    assert sum(g["total_events"] for g in report["sources"].values()) == 8
    with open(f"{out[0]}/quality.json", encoding="utf-8") as f:
        assert json.load(f)["overall"] == whole


def test_report_of_nothing(spark):
    e = normalize(spark.createDataFrame([], "source_file string, seq bigint, raw_bytes binary, raw_text string, raw_text_lossy boolean"))
    from weir.operators.ocsf import to_ocsf

    assert quality.build_report(e, to_ocsf(e))["overall"]["total_events"] == 0


def test_viewer(spark, out):
    e = read_events(spark, f"{out[0]}/events.jsonl").withColumn("source_file", F.lit("f"))
    assert tuple(explore.summary(e).first()) == (8, 1, 4, 1)
    assert explore.top_sources(e).first().asDict() == {"src_ip": "203.0.113.5", "events": 2}
    assert {r.observer_vendor for r in explore.filter_events(e, " 203.0.113.5 ").collect()} == {"Fortinet", "Palo Alto Networks"}
    assert explore.filter_events(e, " ").count() == 8 and explore.filter_events(e, "nope").count() == 0
    assert set(explore.page(e)) == {"summary", "top_sources", "rows"}


def test_verify_clean_and_tampered(spark, out):
    raw, events = read_raw(spark, f"{out[0]}/raw.jsonl"), read_events(spark, f"{out[0]}/events.jsonl")
    assert batch.verify_output(spark, out[0])["ok"]
    is_sshd = F.col("source_file") == "sshd.log"
    edited = raw.withColumn("raw_text", F.when(is_sshd, "changed").otherwise(F.col("raw_text")))
    assert [m["kind"] for m in verify(edited, events)["mismatches"]] == ["raw_hash_mismatch"]
    rehashed = edited.withColumn("raw_hash", F.when(is_sshd, F.sha2(F.col("raw_text").cast("binary"), 256)).otherwise(F.col("raw_hash")))
    assert [m["kind"] for m in verify(rehashed, events)["mismatches"]] == ["event_hash_mismatch"]
    joined = quality.build_report(events.withColumn("source_file", F.lit("f")), read_ocsf(spark, f"{out[0]}/ocsf.jsonl"))["overall"]
    assert {k: v for k, v in joined.items() if k != "top_unmapped_keys"} == {k: v for k, v in out[1]["overall"].items() if k != "top_unmapped_keys"}
    assert [m["kind"] for m in verify(raw.where(~is_sshd), events)["mismatches"]] == ["missing_raw_id"]
    assert verify(read_raw(spark, "/nowhere/raw.jsonl"), read_events(spark, "/nowhere/e"))["ok"]


def brute_records(data: bytes):
    groups = []
    for line in data.split(b"\n"):
        line = line[:-1] if line.endswith(b"\r") else line
        if line:
            groups.append([line]) if line[:1] not in (b" ", b"\t") or not groups else groups[-1].append(line)
    return [b"\n".join(g) for g in groups]


ADVERSARIAL = b"  leading\r\n\ta\xff\r\n\r\nfirst\r\n\r\n  cont\r\n   \n\nx\r\r\n\n\n y\nlast \xc3\xa9\r\n z\r"


def test_framing(spark, tmp_path):
    (tmp_path / "a b.log").write_bytes(ADVERSARIAL)
    (tmp_path / "big.log").write_bytes(b"".join(b"line %d\n%s" % (i, b" more\n" * (i % 3)) for i in range(5000)))
    (tmp_path / "empty.log").write_bytes(b"")
    want = {(p.name, i): b for p in tmp_path.iterdir() for i, b in enumerate(brute_records(p.read_bytes()))}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for whole in (True, False):
            got = {(r.source_file, r.seq): bytes(r.raw_bytes) for r in read_records(spark, str(tmp_path), whole).collect()}
            assert got == want, whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


MESSY = {
    "lossy": b"deny 10.0.0.9 -> 10.0.0.10 \xff junk",
    "multiline": b"src=10.4.4.4 dst=10.4.4.5 action=Drop BEGIN_TRACE\n  at one\n  at two",
    "plus_0530": b'{"timestamp":"2026-09-28T09:05:00+05:30","src":"10.1.1.1","dst":"10.1.1.2"}',
    "minus_0700": b'{"timestamp":"2026-09-28T09:06:00-0700","src":"10.1.1.1","dst":"10.1.1.2"}',
    "leef": b"LEEF:1.0|Juniper|SRX|12.1|RT_FLOW|src=10.3.3.3 dst=10.3.3.4 spt=1111 dpt=443 proto=tcp allow",
    "ipv6": b"flow_src=2001:db8:0:0:0:0:0:1 2001:db8:0:0:0:0:0:2 drop",
    "noise": b"zzz qqq xkcd fluffernutter",
    "pri_kv": b"<134>Sep 28 09:10:00 h app: policy_violation src=172.20.0.5 dst=172.20.0.6 spt=5000 dpt=443 proto=TCP action=deny",
    "bad_time": b'{"when":1758960000,"src":"10.6.6.6"}',
    "eve_edge": b'{"event_type":"alert","src_ip":"2001:db8::10","proto":"SCTP","alert":{"action":"blocked","severity":1}}',
    "pa_hint": b"PA-5220 traffic 10.7.7.7 to 10.7.7.8 allow",
    "ambiguous": b"Source=WinDefender 10.8.8.8 203.0.113.99 blocked",
    "odd_cef": b"CEF:0|Zscaler|NSS|5|1|Web|High|sip=10.9.9.1 dip=10.9.9.2 spt=51000",
    "pri_only": b"<13>",
    "nested": b'{"a":{"SRC":"1.1.1.1","proto":"UDP"},"src":"2.2.2.2","up":true,"n":null,"l":[1]}',
    "bad_port": b"src=1.1.1.1 srcport=http dstport=80 proto=6",
    "broken_json": b'{"timestamp":"broken, "event_type": alert src_ip:10.0.0.7',
    "multiline_cef": b"CEF:0|V|P|1|2|N|3|src=1.1.1.1\n dst=2.2.2.2",
    "two_proto": b"date=2026-01-01 proto=1 proto=17 action=accept",
    "clock": b"at 10:31:00 something happened",
}


@pytest.fixture(scope="module")
def messy(spark):
    from weir.operators.ocsf import to_ocsf
    from weir.sources.records import finish

    df = finish(spark.createDataFrame([(k, i, bytearray(v)) for i, (k, v) in enumerate(MESSY.items())], "source_file string, seq bigint, raw_bytes binary"))
    e = normalize(df, INGEST).cache()
    o = {r.metadata.raw_event_id: r for r in to_ocsf(e, 2026).collect()}
    return {r.source_file: (r, o[r.event_id]) for r in e.collect()}


def test_messy(messy):
    e = {k: v[0] for k, v in messy.items()}
    o = {k: v[1] for k, v in messy.items()}
    assert (e["lossy"].parse_status, e["lossy"].network_src_ip, e["lossy"].network_dst_ip, e["lossy"].event_outcome) == ("partial", "10.0.0.9", "10.0.0.10", "failure")
    assert e["lossy"].provenance_raw_hash == hashlib.sha256(MESSY["lossy"]).hexdigest() and "\ufffd" in e["lossy"].provenance_raw_text
    assert (e["multiline"].parse_parser, e["multiline"].network_dst_ip) == ("checkpoint", "10.4.4.5")
    assert o["plus_0530"].time == 1790566500000 and o["minus_0700"].time == 1790611560000
    assert (e["leef"].observer_vendor, e["leef"].observer_product, e["leef"].network_src_port, e["leef"].network_dst_port, e["leef"].event_outcome) == ("Juniper", "SRX", 1111, 443, "success")
    assert (e["ipv6"].network_src_ip, e["ipv6"].network_dst_ip, e["ipv6"].event_action) == ("2001:db8:0:0:0:0:0:1", "2001:db8:0:0:0:0:0:2", "drop")
    assert e["noise"].parse_status == "failed" and e["noise"].parse_format is None
    assert (e["pri_kv"].timestamp, e["pri_kv"].parse_format, e["pri_kv"].network_transport, e["pri_kv"].parse_confidence) == ("Sep 28 09:10:00", "kv", "tcp", 1.0)
    assert e["bad_time"].timestamp is None and o["bad_time"].time == 1790812800000
    assert (o["eve_edge"].class_uid, o["eve_edge"].disposition, o["eve_edge"].severity_id, e["eve_edge"].network_transport) == (2004, "Blocked", 4, "sctp")
    assert (e["pa_hint"].observer_vendor, e["pa_hint"].event_outcome) == ("Palo Alto Networks", "success")
    assert e["ambiguous"].network_src_ip == "10.8.8.8" and e["ambiguous"].unmapped == {"source": '"WinDefender"'}
    assert (e["odd_cef"].observer_vendor, e["odd_cef"].event_severity, e["odd_cef"].network_src_port, o["odd_cef"].severity_id) == ("Zscaler", "High", 51000, 0)
    assert set(e["odd_cef"].unmapped) == {"version", "device_version", "signature_id", "sip", "dip"}
    assert (e["pri_only"].parse_confidence, e["pri_only"].parse_format, e["pri_only"].unmapped) == (0.25, "syslog", {"pri": '"13"'})
    assert (e["nested"].network_src_ip, e["nested"].network_transport) == ("2.2.2.2", "udp")
    assert {k: json.loads(v) for k, v in e["nested"].unmapped.items()} == {"a": {"SRC": "1.1.1.1", "proto": "UDP"}, "up": True, "n": None, "l": [1]}
    assert (e["bad_port"].parse_parser, e["bad_port"].network_src_port, e["bad_port"].network_dst_port, e["bad_port"].unmapped) == ("fortigate", None, 80, {"src": '"1.1.1.1"', "srcport": '"http"'})
    assert (e["broken_json"].parse_status, e["broken_json"].network_src_ip) == ("partial", "10.0.0.7")
    assert e["multiline_cef"].parse_parser == "generic" and e["multiline_cef"].network_dst_ip == "2.2.2.2"
    assert (e["two_proto"].network_transport, e["two_proto"].event_outcome, e["two_proto"].timestamp) == ("udp", "unknown", "2026-01-01")
    assert e["clock"].network_src_ip == "10:31:00"


def test_lossy_bytes_are_kept(spark):
    from weir.plans.normalize import raw_rows, with_identity
    from weir.sources.records import finish

    df = finish(spark.createDataFrame([("f", 0, bytearray(MESSY["lossy"])), ("f", 1, bytearray(b"ok"))], "source_file string, seq bigint, raw_bytes binary"))
    rows = {r.raw_text_lossy: r for r in raw_rows(with_identity(df, INGEST)).collect()}
    assert base64.b64decode(rows[True].raw_bytes_b64) == MESSY["lossy"] and rows[False].raw_bytes_b64 == ""
    assert rows[True].raw_text == MESSY["lossy"].decode("utf-8", "replace")


def test_ids_are_stable(spark, corpus):
    ids = [sorted(r.event_id for r in normalize(read_records(spark, corpus), INGEST).select("event_id").collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 8
