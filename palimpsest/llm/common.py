"""Shared helpers of the training-data operators.

Every operator here takes a DataFrame with at least the columns it names and
ignores all others, so extra columns with any names pass by unharmed.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts may be long, so batches stay far below Spark's default of 10,000.
BATCH_ROWS = 1000

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes in one Arrow batch; a batch of one row may be larger.
BATCH_BYTES = 16 << 20


def prepare(df: DataFrame) -> SparkSession:
    """Session of ``df``, set up so that Arrow batches stay small and workers can import this package."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, known) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and all runs on one machine, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a table; at exit the session may be gone already, and then nothing can be deleted."""
    if spark.sparkContext._jsc is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def stored(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage is cut, a lost executor costs nothing.

    ``replaces``: a stored table that nothing reads any more once this one is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_quiet_remove, spark, path)
    if replaces is not None:
        _remove(spark, replaces._stored_at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _quiet_remove(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the JVM has ended before Python: the folder's owner cleans up
        return


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """Rows as one column ``row`` beside named others, so that no name of theirs can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(name) for name, c in more.items()])


def ascii_lower(data: bytes) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and nothing else changed (``bytes.lower`` is ASCII only)."""
    return data.lower()


def texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without a detour over ``str``."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _released() -> None:
    """Gives memory that is free back to the system; a worker goes on to later tasks, and would hold the most that any of them took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(function):
    """A function on batches, after which its worker holds no more than it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _released()

    return run


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, for work whose tables are many times a batch's size."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def arrow_map(df: DataFrame, names: Iterable[str], function, schema: str) -> DataFrame:
    """``mapInArrow`` over just the named columns."""
    prepare(df)
    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(releasing(function), schema)


def as_batches(columns: dict[str, tuple[list | np.ndarray, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))
