"""What the operators share: tables, the shared folder, and Arrow row mapping."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_BYTES = 8 << 20
PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary one; a cluster must set it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weir-shared-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/weir-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{own_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, batch_rows: int = 1000) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there,
    and a lost executor costs nothing but the tasks that it was running. Meanwhile Spark
    sends Python at most BATCH_BYTES and batch_rows at once."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    batch = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)}
    before = {k: spark.conf.get(k, None) for k in batch}
    try:
        for k, v in batch.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """drop(), and collect the driver's garbage: only then does Spark delete the shuffle
    files of plans that are gone."""
    drop(spark, *tables)
    gc.collect()
    spark._jvm.System.gc()


def drop_materialized(spark: SparkSession) -> None:
    """Delete every table that materialize() wrote in this application, once the results
    are stored; those of other applications on the same folder stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor."""
    context = spark.sparkContext
    if getattr(context, "_weir_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="weir-code-"), "weir_code.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    z.write(at, os.path.relpath(at, os.path.dirname(PACKAGE)))
    context.addPyFile(out)
    context._weir_shipped = True


def parts_of(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and `size` bytes, or of one row."""
    todo = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
    while todo:
        part = todo.pop()
        if part.num_rows > 1 and part.nbytes > size:
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(df: DataFrame, fn: Callable[..., dict[str, list]], schema: StructType | str, batch_rows: int = 1000, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow over small batches. fn gets one column list for each column of df and
    returns one list for each field of schema. It holds at most batch_rows rows and
    batch_bytes bytes at a time (or one row, if that is larger); what Spark sends at once
    is bounded by its own spark.sql.execution.arrow.maxBytesPerBatch. No setting of the
    session changes."""
    ship(df.sparkSession)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives large batches back at once
        for batch in batches:
            for part in parts_of(batch, batch_rows, batch_bytes):
                got = fn(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def fold(column: str) -> F.Column:
    """Remainder source of the folds: the unsigned CRC-32 of doc_id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def text_bytes(column: str = "text") -> F.Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
