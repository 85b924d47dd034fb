"""Live ingest (R2-R6, K2, E3): the batch transform over micro-batches.

Every batch writes its own folders under the outputs, so a batch that runs again replaces
what it wrote. The report comes from running sums: a batch adds its own to those that the
batch before it left, stores the result under its own number and deletes what is older
than its predecessor's. No batch reads older events again, and the sums grow with groups
and keys, not with batches.
"""

from __future__ import annotations

import argparse

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.operators.ocsf import to_ocsf
from weir.operators.quality import add_partials, grade, partials, report_json, report_of
from weir.plans.batch import CONFIGS, parser_options
from weir.plans.normalize import event_columns, parse, raw_rows, with_identity
from weir.sources.files import delete, exists, names, write_text
from weir.sources.jsonl import event_json, ocsf_json, raw_json, write_lines
from weir.sources.records import finish
from weir.streaming.syslog import FORMAT, SyslogSource


def messages(stream: DataFrame) -> DataFrame:
    """Records of a stream of messages: line ends cut, blank ones dropped, no merging of
    continuation lines."""
    text = F.regexp_replace(F.decode("raw_bytes", "ISO-8859-1"), r"[\r\n]+\z", "")
    kept = stream.withColumn("raw_bytes", F.encode(text, "ISO-8859-1")).where(F.length(F.trim(F.regexp_replace(text, r"[\t\r\n\f\x0b]", " "))) > 0)
    return finish(kept)


def write_batch(batch: DataFrame, batch_id: int, target: str, **options) -> None:
    spark = batch.sparkSession
    identified = with_identity(messages(batch), options.pop("ingest_time", None)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if identified.isEmpty():
            return
        year = options.pop("year", None)
        events = event_columns(parse(identified, **options))
        ocsf = to_ocsf(events, year)
        for name, df, line in (("raw", raw_rows(identified), raw_json()), ("events", events, event_json()), ("ocsf", ocsf, ocsf_json())):
            write_lines(df, line, f"{target}/{name}.jsonl/batch={batch_id}")
        sums = running_sums(spark, partials(grade(events, year)), batch_id, f"{target}/_quality")
    finally:
        identified.unpersist()
    write_text(spark, f"{target}/quality.json", report_json(report_of(*sums)))


def running_sums(spark: SparkSession, own: tuple[DataFrame, DataFrame], batch_id: int, folder: str) -> list[DataFrame]:
    """Sums of all batches up to this one, stored. They rest on the last batch below it, so
    one that runs again counts once."""
    done = sorted(int(n.removeprefix("batch=")) for n in names(spark, folder) if n.startswith("batch="))
    before = [n for n in done if n < batch_id and exists(spark, f"{folder}/batch={n}/_done")]
    out = []
    for name, df in zip(("groups", "keys"), own):
        if before:
            df = add_partials(name, df.unionByName(spark.read.parquet(f"{folder}/batch={before[-1]}/{name}")))
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}/{name}")
        out.append(spark.read.parquet(f"{folder}/batch={batch_id}/{name}"))
    write_text(spark, f"{folder}/batch={batch_id}/_done", "")
    for n in done:
        if before and n < before[-1]:
            delete(spark, f"{folder}/batch={n}")
    return out


def start(stream: DataFrame, target: str, checkpoint: str | None = None, trigger: dict | None = None, **options):
    """Run a stream of (source_file, seq, raw_bytes) into the outputs under target."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint or f"{target}/_checkpoint")
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).foreachBatch(lambda df, n: write_batch(df, n, target, **options)).start()


def listen(spark: SparkSession, target: str, host: str = "127.0.0.1", port: int = 5514, spool: str | None = None, **options):
    """Listen on UDP and TCP and ingest what arrives."""
    spark.dataSource.register(SyslogSource)
    stream = spark.readStream.format(FORMAT).options(host=host, port=str(port), spool=spool or f"{target}/_spool").load()
    return start(stream, target, **options)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Ingest live syslog")
    p.add_argument("target")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=5514)
    p.add_argument("--configs", default=CONFIGS, help="folder of config-driven parsers")
    p.add_argument("--mappings", help="folder of mappings that replace the built-in ones")
    a = p.parse_args(argv)
    listen(SparkSession.builder.getOrCreate(), a.target, a.host, a.port, **parser_options(a.configs, a.mappings)).awaitTermination()


if __name__ == "__main__":
    main()
