"""What the operators of this subpackage share: Arrow plumbing, spooling, small expressions."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows and bytes of an Arrow batch at most; texts are long, so batches are kept small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to what long texts need; it never raises it."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        try:
            now = int(spark.conf.get(key) or 0)
        except Exception:  # the setting's default is no plain number
            now = 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def map_arrow(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """`mapInArrow` with batches that suit long texts."""
    small_batches(df.sparkSession)
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='arcspan-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the shared folder's owner clears it
        pass


class Spool:
    """Intermediate tables as Parquet in the shared folder; lost executors lose none of them.

    A table's plan starts at its files, so lineage is cut. `drop` removes a table that no later
    plan reads; the others go when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/arcspan-{uuid.uuid4().hex}", 0
        atexit.register(_delete, spark, self.root)

    def write(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        """Write `df`; the table, read again."""
        self.n += 1
        path, schema = f"{self.root}/{self.n}", df.schema
        df.write.parquet(path, compression=codec)
        out = self.spark.read.schema(schema).parquet(path)
        out.spooled = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that `write` returned."""
        _delete(self.spark, df.spooled)


def remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo `modulus`; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string").cast("binary")) % modulus


def texts(column: pa.Array) -> list[str]:
    """The column's strings; null is empty."""
    return [x or "" for x in column.to_pylist()]


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with the same key, of batches in its order."""
    held, now = [], None
    for batch in batches:
        if not len(batch):
            continue
        k = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:]):
            if held and k[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = k[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def blobs(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """`data` cut into binary values of `counts` elements."""
    end = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * np.int32(data.dtype.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(end), pa.py_buffer(np.ascontiguousarray(data))])
