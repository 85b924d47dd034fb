"""The shape of the plans: no shuffle in parsing, pruned scans, no Python."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from weir.plans.normalize import normalize
from weir.plans.rendered import records
from weir.queries import QUERIES
from weir.sources.records import records_of


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parsing_is_narrow_and_native(spark, sf_dir):
    p = plan(normalize(records(spark, sf_dir)))
    assert "Exchange" not in p and not re.search("Python|Pandas|Arrow", p)


def test_a_filter_on_a_field_keeps_the_plan_small(spark, sf_dir):
    e = normalize(records(spark, sf_dir))
    assert len(plan(e.where("parse_parser = 'cef'"))) < 2 * len(plan(e))


def test_scans_read_only_what_is_asked(spark, sf_dir):
    p = plan(QUERIES["generic_ips"](spark, sf_dir))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", p)


def test_report_shuffles_partial_sums(spark, sf_dir):
    p = plan(QUERIES["quality_by_source"](spark, sf_dir))
    assert p.count("Exchange") <= 3 and "partial_" in p


def test_stored_events_are_filtered_at_the_scan(spark, sf_dir, tmp_path):
    normalize(records(spark, sf_dir)).write.parquet(str(tmp_path / "e"))
    p = plan(spark.read.parquet(str(tmp_path / "e")).where(F.col("parse_parser") == "cef").select("network_src_ip"))
    assert "EqualTo(parse_parser,cef)" in p


def test_a_filter_on_the_file_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", 1, "src=1.1.1.1 dst=2.2.2.2 action=x")], "source_file string, seq bigint, line string").write.parquet(str(tmp_path / "l"))
    e = normalize(records_of(spark.read.parquet(str(tmp_path / "l"))))
    found = e.where("source_file = 'a' and parse_parser = 'checkpoint'")
    assert "EqualTo(source_file,a)" in plan(found) and found.count() == 1


def test_whole_stages_compile(spark, sf_dir, capfd):
    spark.sparkContext.setLogLevel("WARN")
    try:
        for name in ("frame_continuations", "quality_by_source", "mode_vote"):
            QUERIES[name](spark, sf_dir).count()
    finally:
        spark.sparkContext.setLogLevel("ERROR")
    assert "64 KB" not in capfd.readouterr().err
