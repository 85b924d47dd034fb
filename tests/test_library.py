"""Registered queries against DuckDB, generated lines, the viewer, and independence."""

from __future__ import annotations

import json
import math
import os
import subprocess
import sys
import threading
import urllib.request

import duckdb
import pytest

from tests.conftest import ROOT
from weir.queries import ORACLES, QUERIES

TABLES = "events documents"


def rows(names, data):
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES.split():
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, rel = QUERIES[name](spark, sf_dir), db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


def test_generated_lines(spark):
    from weir.plans.normalize import normalize
    from weir.sources.generator import SPIKE_SOURCE, lines
    from weir.sources.records import records_of

    made = lines(spark, 4000).withColumnRenamed("id", "seq").cache()
    assert made.where(made.line.contains(SPIKE_SOURCE)).count() > 200 and made.where("line is null").count() == 0
    again = {r.seq: r.line for r in lines(spark, 4000).withColumnRenamed("id", "seq").collect()}
    assert {r.seq: r.line for r in made.collect()} == again
    status = {r.parse_status: r["count"] for r in normalize(records_of(made), "2026-01-01T00:00:00+00:00").groupBy("parse_status").count().collect()}
    assert sum(status.values()) == 4000 and status["ok"] > 3900


def test_viewer(spark, tmp_path):
    from weir.plans.normalize import normalize
    from weir.sources.jsonl import event_json, write_lines
    from weir.sources.records import records_of
    from weir.viewer import server

    df = spark.createDataFrame([("f", 0, "src=1.1.1.1 dst=2.2.2.2 action=<b>"), ("f", 1, "src=3.3.3.3 dst=4.4.4.4 action=Drop")], "source_file string, seq bigint, line string")
    write_lines(normalize(records_of(df)), event_json(), str(tmp_path / "events.jsonl"))
    s = server(spark, str(tmp_path))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    get = lambda path: urllib.request.build_opener(urllib.request.ProxyHandler({})).open(f"http://127.0.0.1:{s.server_address[1]}{path}", timeout=60).read().decode()
    try:
        page = get("/?q=1.1.1.1")
        assert "&lt;b&gt;" in page and "<b>" not in page and "4.4.4.4" not in page and "event_count: 2" in page
        assert len([json.loads(x) for x in get("/events.jsonl").splitlines()]) == 2
        with pytest.raises(urllib.error.HTTPError):
            get("/other")
    finally:
        s.shutdown()
        s.server_close()


def test_the_library_does_without_the_corpus_operators():
    code = "import sys; sys.modules['weir.llm'] = None; import weir.queries, weir.plans.batch, weir.streaming.ingest, weir.onboard.cli, weir.viewer; assert not any(m.startswith('weir.llm.') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_imports_without_the_corpus_operators(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "weir", ".git"):
            os.symlink(os.path.join(ROOT, name), tmp_path / name)
    os.mkdir(tmp_path / "weir")
    for name in os.listdir(os.path.join(ROOT, "weir")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "weir", name), tmp_path / "weir" / name)
    os.remove(tmp_path / "__spark_entry__.py")
    with open(os.path.join(ROOT, "__spark_entry__.py")) as a, open(tmp_path / "__spark_entry__.py", "w") as b:
        b.write(a.read())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'detect' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
