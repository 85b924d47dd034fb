"""Log files to logical records (S1-S7): byte-exact framing without a per-file task.

Records: source_file, seq, raw_bytes, raw_text, raw_text_lossy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.session import configure

WHOLE_FILE_BYTES = 8 << 20


def decoded(raw: Column) -> dict[str, Column]:
    """Text of bytes: as they are if valid UTF-8, else with replacement characters."""
    s = raw.cast("string")
    valid = F.is_valid_utf8(s)
    return {"raw_text": F.make_valid_utf8(s), "raw_text_lossy": ~valid}


def finish(df: DataFrame) -> DataFrame:
    return df.withColumns(decoded(F.col("raw_bytes"))).select("source_file", "seq", "raw_bytes", "raw_text", "raw_text_lossy")


def file_name(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, r"([^/]*)\z", 1))


def frame_files(files: DataFrame) -> DataFrame:
    """Framing of small files, one row each (path, content), in one projection.

    A line starts a record unless it begins with a space or tab; empty lines vanish; one
    carriage return before a line feed or the end is dropped.
    """
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), r"\r(?=\n|\z)", "")
    parts = F.split(text, r"\n+(?![ \t\n])")
    clean = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"\A\n+|\n+\z", ""), r"\n+", "\n"))
    kept = F.filter(clean, lambda p: p != "")
    rows = files.select(file_name(F.col("path")).alias("source_file"), F.posexplode(kept).alias("seq", "part"))
    return finish(rows.select("source_file", F.col("seq").cast("bigint").alias("seq"), F.encode("part", "ISO-8859-1").alias("raw_bytes")))


def frame_lines(lines: DataFrame) -> DataFrame:
    """Framing of files of any size from lines (file, split, at, value): `at` orders the
    lines of a split, splits are ordered by their offset.

    Groups are numbered within each split, whose size the reader bounds; a small table of
    splits carries the count over and hands the continuation lines at the head of a split
    to the last group of the one before.
    """
    raw = F.col("value").cast("binary")
    hexed = F.hex(raw)
    raw = F.when(hexed.endswith("0D"), F.substring(raw, F.lit(1), F.octet_length(raw) - 1)).otherwise(raw)
    kept = lines.withColumn("raw", raw).where(F.octet_length("raw") > 0)
    first = F.hex(F.substring("raw", 1, 1))
    starts = kept.withColumn("starts", (~first.isin("20", "09")).cast("bigint"))
    splits = starts.groupBy("file", "split").agg(F.sum("starts").alias("n"), F.min_by("starts", "at").alias("head"))
    # A continuation with nothing before it, at the very start of a file, opens a group.
    order = Window.partitionBy("file").orderBy("split")
    splits = splits.withColumn("orphan", ((F.row_number().over(order) == 1) & (F.col("head") == 0)).cast("bigint"))
    before = F.coalesce(F.sum(F.col("n") + F.col("orphan")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "split", (before + F.col("orphan")).alias("before"))
    within = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = starts.withColumn("inner", F.sum("starts").over(within)).join(splits, ["file", "split"])
    seq = F.col("before") + F.col("inner") - 1
    grouped = numbered.groupBy("file", seq.alias("seq")).agg(F.sort_array(F.collect_list(F.struct("split", "at", "raw"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(None).cast("binary"), lambda a, p: F.when(a.isNull(), p["raw"]).otherwise(F.concat(a, F.lit(b"\n"), p["raw"])))
    return finish(grouped.select(F.col("file").alias("source_file"), "seq", joined.alias("raw_bytes")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "false").text(path)
    return text.select(file_name(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")


def read_records(spark: SparkSession, path: str, whole_files: bool | None = None) -> DataFrame:
    """Records of the regular files of a folder. Small files are framed in one projection,
    anything larger by splits; whole_files forces one or the other."""
    configure(spark)
    if whole_files is None:
        listed = spark.read.format("binaryFile").load(path).select("length").agg(F.max("length")).first()[0]
        whole_files = listed is None or listed <= WHOLE_FILE_BYTES
    if whole_files:
        return frame_files(spark.read.format("binaryFile").load(path).select("path", "content"))
    return frame_lines(read_lines(spark, path))


def records_of(df: DataFrame, line: str = "line", source: str = "source_file", seq: str = "seq") -> DataFrame:
    """Records of a table that holds one line a row."""
    return finish(df.select(F.col(source).alias("source_file"), F.col(seq).cast("bigint").alias("seq"), F.col(line).cast("binary").alias("raw_bytes")))
