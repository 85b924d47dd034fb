"""JSON-lines sinks and readers (K1, S8) of raw rows, events and OCSF records.

A sink writes a folder of part files; the reader takes a folder or a single file and
gives an empty frame where there is none. Only a line feed ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from weir.functions.text import empty_to_null, quote
from weir.plans.schema import EVENT_KEYS, RAW_KEYS, column_of
from weir.session import configure
from weir.sources.files import exists


def string(c: Column | str) -> Column:
    return quote(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")))


def number(c: Column | str) -> Column:
    """A number, or an empty string where there is none."""
    return F.coalesce((c if isinstance(c, Column) else F.col(c)).cast("string"), F.lit('""'))


def object_(items: list[tuple[str, Column]]) -> Column:
    parts = []
    for i, (k, v) in enumerate(items):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{k}":'), v]
    return F.concat(*parts, F.lit("}"))


def map_of_json(m: Column | str) -> Column:
    m = F.coalesce(m if isinstance(m, Column) else F.col(m), F.create_map().cast("map<string,string>"))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(quote(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def raw_json() -> Column:
    return object_([(k, F.col(k).cast("string") if k == "raw_text_lossy" else string(k)) for k in RAW_KEYS])


def event_json() -> Column:
    def value(key: str) -> Column:
        c = F.col(column_of(key))
        if key.endswith("_port"):
            return number(c)
        if key == "event.severity":
            return F.when(F.col("severity_is_int") & c.isNotNull(), c).otherwise(string(c))
        if key == "parse.confidence":
            return F.when(F.col("parse_status") == "failed", "0").otherwise(F.coalesce(c.cast("string"), F.lit("null")))
        return map_of_json(c) if key == "unmapped" else string(c)

    return object_([(k, value(k)) for k in EVENT_KEYS])


def ocsf_json() -> Column:
    plain = ("class_uid", "category_uid", "activity_id", "severity_id", "time", "disposition_id")
    end = lambda n: object_([("ip", string(f"{n}.ip")), ("port", number(f"{n}.port"))])
    nested = {
        "src_endpoint": end("src_endpoint"), "dst_endpoint": end("dst_endpoint"), "connection_info": object_([("protocol_name", string("connection_info.protocol_name"))]),
        "metadata": object_([(n, string(f"metadata.{n}")) for n in ("product", "vendor_name", "version", "raw_data_hash", "raw_event_id")]), "unmapped": map_of_json("unmapped"),
    }
    order = ("class_uid", "class_name", "category_uid", "category_name", "activity_id", "activity_name", "severity_id", "severity", "time", "action", "disposition_id", "disposition", *nested)
    return object_([(k, nested[k] if k in nested else number(k) if k in plain else string(k)) for k in order])


def write_lines(df: DataFrame, line: Column, path: str, mode: str = "overwrite") -> None:
    df.select(line.alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows and, as `seq`, their places: file, split, order within it. Files are ordered
    by path, whatever order Spark reads them in."""
    configure(spark)
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("seq", F.lit(None).cast(PLACE))
    df = spark.read.schema(schema).option("lineSep", "\n").option("recursiveFileLookup", "true").json(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    return df.withColumn("seq", place)


PLACE = "struct<file:string,split:bigint,at:bigint>"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows and their places; where an id occurs twice, the later place counts."""
    return _read(spark, path, StructType([StructField(k, BooleanType() if k == "raw_text_lossy" else StringType()) for k in RAW_KEYS]))


def _json_map(c: Column) -> Column:
    return F.transform_values(F.from_json(c, "map<string,variant>"), lambda _, v: F.to_json(v))


def read_events(spark: SparkSession, path: str, raw: str | None = None) -> DataFrame:
    """Events as the engine holds them; numbers read back from mixed values. Their file's
    name is in the raw rows alone: given those, it is joined by id, else it is NULL."""
    df = _read(spark, path, StructType([StructField(k, StringType()) for k in EVENT_KEYS]))
    cols = []
    for k in EVENT_KEYS:
        c, name = F.col(f"`{k}`"), column_of(k)
        if k == "unmapped":
            cols.append(_json_map(c).alias(name))
        else:
            cols.append((c.try_cast("int") if k.endswith("_port") else c.try_cast("double") if k == "parse.confidence" else empty_to_null(c)).alias(name))
    whole = F.col("event_severity").rlike(r"\A-?\d+\z") & (F.col("parse_parser") != "cisco_asa")
    events = df.select(*cols, "seq").withColumn("severity_is_int", whole)
    if raw is None:
        return events.withColumn("source_file", F.lit(None).cast("string"))
    names = read_raw(spark, raw).groupBy(F.col("raw_event_id").alias("provenance_raw_event_id")).agg(empty_to_null(F.max_by("source_file", "seq")).alias("source_file"))
    return events.join(names, "provenance_raw_event_id", "left").select(*events.columns, "source_file")


def read_ocsf(spark: SparkSession, path: str) -> DataFrame:
    end = "struct<ip:string,port:string>"
    ddl = f"class_uid int, class_name string, category_uid int, category_name string, activity_id int, activity_name string, severity_id int, severity string, time bigint, action string, disposition_id int, disposition string, src_endpoint {end}, dst_endpoint {end}, connection_info struct<protocol_name:string>, metadata struct<product:string,vendor_name:string,version:string,raw_data_hash:string,raw_event_id:string>, unmapped string"
    df = _read(spark, path, StructType.fromDDL(ddl)).drop("seq")
    point = lambda n: F.struct(empty_to_null(F.col(f"{n}.ip")).alias("ip"), F.col(f"{n}.port").try_cast("int").alias("port")).alias(n)
    return df.withColumns({n: point(n) for n in ("src_endpoint", "dst_endpoint")} | {"unmapped": _json_map(F.col("unmapped")), "connection_info": F.struct(empty_to_null(F.col("connection_info.protocol_name")).alias("protocol_name")), "action": empty_to_null(F.col("action"))})
