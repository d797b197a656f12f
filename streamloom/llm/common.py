"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A measured table of at most so many bytes may be broadcast; a larger one is shuffled.
BROADCAST_BYTES = 64 << 20

_A_TO_Z = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def ascii_lower(data: bytes) -> bytes:
    """Lower-cases A-Z and leaves every other byte."""
    return data.translate(_A_TO_Z)


#: What an Arrow batch to or from a Python worker holds at most, whichever comes first.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches bounded by bytes: whole texts are long, and every task holds some batches outside the heap."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none, a temporary one of a local session."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="streamloom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lost executors cost no more than the rows since."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, size, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the bytes that size (a column) sums to are at most `most`; else df."""
    total = df.agg(F.sum(size).cast("long")).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many _ behind it as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on, so that an operator's own names can't clash with them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def strings(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def batch_of(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more; else they stay until the driver happens to collect its garbage.

    References that Python has dropped reach the JVM through a thread that wakes once a second.
    A local session, as in tests, is left alone.
    """
    if spark.sparkContext.master.startswith("local["):
        return
    for _ in range(2):  # what the first round frees may hold more
        gc.collect()
        time.sleep(1.2)
        spark.sparkContext._jvm.System.gc()
