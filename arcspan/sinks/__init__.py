"""Sinks: intermediate tables, feature files with contracts, logs, exports and upserts."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
import warnings
from collections.abc import Callable
from pathlib import Path
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(df: DataFrame) -> str:
    """The folder that driver and executors share; a local one only for a local master."""
    found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = df.sparkSession.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='arcspan-')}"
        df.sparkSession.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spool(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: its lineage ends there.

    The files go when the driver ends; `unspool` removes them before.
    """
    path = f"{shared_dir(df)}/spool-{uuid.uuid4().hex}"
    atexit.register(_remove, df.sparkSession, path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.spooled = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the shared folder's owner clears it
        pass


def unspool(*tables: DataFrame) -> None:
    """Remove tables that `spool` returned and that no later plan reads."""
    for df in tables:
        if path := getattr(df, "spooled", None):
            _remove(df.sparkSession, path)


def write_sorted(df: DataFrame, path: str, columns: list[str]) -> None:
    """A table sorted by ranges of columns, so a filter on them skips files and row groups."""
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def write_index(postings: DataFrame, lengths: DataFrame, path: str, vectors: DataFrame | None = None) -> None:
    """A retrieval index: postings sorted by term, lengths, and the vectors where there are any."""
    write_sorted(postings, f"{path}/postings", ["term"])
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths that `write_index` wrote; vectors are read by `spark.read.parquet`."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


def index_or_append(index: Callable[[DataFrame], None], df: DataFrame, path: str, time: str) -> bool:
    """Rows given to an index; where that fails, appended by day instead. True if the index took them.

    As the function of a `foreachBatch`: `lambda batch, _: index_or_append(write, batch, path, "time")`.
    """
    try:
        index(df)
        return True
    except Exception as e:  # whatever the index raises, the rows must not be lost
        warnings.warn(f"index failed, rows appended to {path}: {e}", stacklevel=2)
        append_daily(df, path, time)
        return False


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last `n` rows of an order, newest first (a report's own limit)."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def write_features(df: DataFrame, path: str) -> dict[str, str]:
    """Features as Parquet, and their contract (name to type) beside them, read from the schema."""
    df.write.mode("overwrite").parquet(path)
    contract = dict(df.dtypes)
    df.sparkSession.createDataFrame([(json.dumps(contract),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_contract")
    return contract


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows appended as JSON lines."""
    df.write.mode("append").json(path)


def append_daily(df: DataFrame, path: str, time: str) -> None:
    """Rows appended as JSON, a folder for each day: what is written where no index can be reached."""
    df.withColumn("date", F.to_date(time)).write.mode("append").partitionBy("date").json(path)


def upsert_log(df: DataFrame, path: str) -> None:
    """An upsert as an append: readers take the latest row of each key."""
    df.write.mode("append").parquet(path)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key of an append log."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_p", place).filter("_p = 1").drop("_p")


#: Rows of a graph that is exported as one file, at most.
ONE_FILE = 1_000_000


def export_node_link(nodes: DataFrame, edges: DataFrame, path: str, most: int = ONE_FILE) -> None:
    """A graph as node-link JSON in one file; graphs of more than `most` rows raise ValueError (write
    their tables instead)."""
    for df in (nodes, edges):
        if df.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} rows: write the tables as Parquet")
    packed = nodes.agg(F.collect_list(F.struct("*")).alias("nodes")).join(edges.agg(F.collect_list(F.struct("*")).alias("links")))
    packed.select(F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(True).alias("multigraph"), "nodes", "links")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def export_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as GraphML on the driver's disk, written row by row; attributes as strings."""
    with Path(path).open("w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml><graph edgedefault="directed">\n')
        for r in nodes.toLocalIterator():
            data = "".join(f"<data key={quoteattr(k)}>{quoteattr(str(v))[1:-1]}</data>" for k, v in r.asDict().items() if k != "node_id" and v is not None)
            out.write(f"<node id={quoteattr(r['node_id'])}>{data}</node>\n")
        for r in edges.toLocalIterator():
            out.write(f"<edge source={quoteattr(r['src'])} target={quoteattr(r['dst'])}><data key=\"type\">{quoteattr(r['type'])[1:-1]}</data></edge>\n")
        out.write("</graph></graphml>\n")


def report(metrics: DataFrame, title: str, most: int = 1_000) -> str:
    """A small table of metrics as Markdown; one of more than `most` rows raises ValueError."""
    rows = metrics.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table as Parquet")
    head = "| " + " | ".join(metrics.columns) + " |\n|" + "---|" * len(metrics.columns) + "\n"
    return f"# {title}\n\n{head}" + "".join("| " + " | ".join(str(v) for v in r) + " |\n" for r in rows)
