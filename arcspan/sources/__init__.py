"""Sources: tables, delimited and JSON telemetry, archives, knowledge bundles, rules, configuration.

Readers return DataFrames; nothing is opened on the driver but small files of settings and rules.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import placed
from ..session import ship
from .archives import INSIDE, TELEMETRY, ArchiveMembers, flat, records



def read_parquet_union(spark: SparkSession, paths: list[str], label: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """Parquet sets united by name; a label column that has other names in some is reconciled."""
    out = None
    for path in sorted(paths):
        df = spark.read.parquet(path)
        for old, new in (renamed or {}).items():
            if old in df.columns and label not in df.columns:
                df = df.withColumnRenamed(old, new)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """`;` if the first line has one, else `,`; one line is read, by Spark, wherever the file lies."""
    first = spark.read.text(path).limit(1).collect()
    return ";" if first and ";" in first[0][0][:2000] else ","


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A delimited file with a header, its delimiter found; without a schema all columns are strings."""
    reader = spark.read.option("header", True).option("sep", sniff_delimiter(spark, path)).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_events_csv(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Headerless (time, user, computer) lines, bz2 or plain; lines with another number of fields
    are left out. `most` is the feature's own row limit."""
    lines = spark.read.text(path).select(F.split("value", ",").alias("f")).filter(F.size("f") == 3)
    out = lines.select(F.col("f")[0].try_cast("long").alias("time"), F.col("f")[1].alias("user"), F.col("f")[2].alias("computer")).filter("time is not null")
    return out.limit(most) if most else out


def read_jsonl(spark: SparkSession, path: str, schema: str, order: str | None = None) -> DataFrame:
    """JSON lines of a schema; lines that are no JSON are left out."""
    df = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = df.filter(F.col("_bad").isNull()).drop("_bad")
    return good.orderBy(order) if order else good


def parse_telemetry(name: str, text: str) -> list[dict]:
    """The records of one telemetry file's text: a JSON array, JSON lines, CSV or YAML; bad lines go."""
    return list(records(name, lambda: io.BytesIO(text.encode())))


def read_archives(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """Rows (path, archive, member, record: map of strings) of the telemetry in ZIP archives.

    `path` is a folder, or one archive, or one member as `archive::member`. Members are read as
    streams, a large one by a task of its own, small ones by a task for many (`archives`); files that are no archive are left out.
    """
    ship(spark)
    spark.dataSource.register(ArchiveMembers)
    path, _, inside = path.partition(INSIDE)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path")
    found = [r.path.replace("file:/", "file:///", 1) if r.path.startswith("file:/") and not r.path.startswith("file://") else r.path for r in files.collect()]
    reader = spark.read.format("archive_members").option("archives", json.dumps(sorted(found)))
    return (reader.option("member", inside or member) if inside or member else reader).load()


def discover(spark: SparkSession, path: str, pattern: str = "*", segment: str | None = None) -> DataFrame:
    """A manifest of files: path, bytes, format, and for archives whether a path segment is theirs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).drop("content")
    out = files.select("path", F.col("length").alias("bytes"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("format"))
    return out.filter(F.array_contains(F.split(F.lower("path"), "/"), segment.lower())) if segment else out


# Names by which a time or a label column is known.
TIME_NAMES, LABEL_NAMES = ["timestamp", "time", "date", "datetime"], ["attack", "label", "class", "is_attack", "anomaly"]
#: Bytes of a file's beginning that are looked at, and lines of them; bytes of a row where none can be seen.
HEAD, LINES, ROW_BYTES = 30_000, 100, 120


def describe_head(text: str, bytes: int) -> tuple[int, int, str | None, str | None]:
    """Rows (estimated by the mean length of the first lines), columns, time and label column of a
    delimited file, from its beginning and its size."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return 0, 0, None, None
    sep = ";" if ";" in lines[0] else ","
    names = [x.strip().strip('"') for x in lines[0].rstrip("\r").split(sep)]
    body = lines[1 : LINES + 1] if len(text) < HEAD or len(lines) < 3 else lines[1:-1][:LINES]
    mean = sum(len(x.encode()) + 1 for x in body) / len(body) if body else ROW_BYTES
    find = lambda known: next((n for n in reversed(names) if n.lower() in known), None)
    return int(bytes / mean), len(names), find(TIME_NAMES), find(LABEL_NAMES)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """What data a folder holds: file, format, bytes, row_estimate, columns, time_column, label_column.

    CSV files and CSV members of archives are looked at by their beginning, Parquet files by their
    footer (rows are exact then). Archives are opened by executors, one at a time; other files
    are not opened. Archives that cannot be read are left out. The driver asks for the beginnings of
    CSV and Parquet files one by one, so this is for folders of thousands of files, not millions.
    """
    ship(spark)
    schema = "file string, format string, bytes long, row_estimate long, columns int, time_column string, label_column string"
    look = lambda pattern: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for archive, content in zip(frame["path"], frame["content"]):
                try:
                    opened = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for info in opened.infolist():
                    kind = info.filename.lower().rsplit(".", 1)[-1]
                    if not info.is_dir() and kind in ("csv", "txt"):
                        with opened.open(info) as member:
                            head = member.read(HEAD).decode("utf-8", "ignore")
                        rows.append((f"{archive}::{info.filename}", kind, info.file_size, *describe_head(head, info.file_size)))
            yield pd.DataFrame(rows, columns=["file", "format", "bytes", "row_estimate", "columns", "time_column", "label_column"])

    out = look("*.zip").select("path", "content").mapInPandas(members, schema)
    # The beginning of a CSV file: its first lines, as Spark reads them (a file is read no further than it has to).
    firsts = [(r["path"], r["length"]) for r in look("*.csv").select("path", "length").collect()]
    rows = []
    for file, size in sorted(firsts):
        head = "\n".join(r[0] for r in spark.read.text(file).limit(LINES + 1).collect())
        rows.append((file, "csv", size, *describe_head(head, size)))
    for r in look("*.parquet").select("path", "length").collect():
        df = spark.read.parquet(r["path"])
        find = lambda known: next((c for c in reversed(df.columns) if c.lower() in known), None)  # noqa: E731, B023
        rows.append((r["path"], "parquet", r["length"], df.count(), len(df.columns), find(TIME_NAMES), find(LABEL_NAMES)))
    return out.unionByName(spark.createDataFrame(rows, schema))


def discover_hosts(spark: SparkSession, path: str) -> DataFrame:
    """Endpoint archives: ZIP files with a folder `host` on their path."""
    return discover(spark, path, "*.zip", "host")


def chunks(df: DataFrame, order: list[str], size: int = 10_000) -> DataFrame:
    """`df` with chunk, so that each chunk has `size` rows in the order (the last fewer): what a reader
    of row groups gives one after the other, here for grouped work in parallel."""
    return placed(df, [F.col(c) for c in order]).withColumn("chunk", F.floor(F.col("_p") / size)).drop("_p", "_p_all")


# STIX object types by their short names, types that are no node, and sources of an object's own id.
STIX_TYPES = {"attack-pattern": "technique", "intrusion-set": "group", "course-of-action": "mitigation", "x-mitre-data-source": "data-source", "x-mitre-tactic": "tactic"}
STIX_SKIPPED = ["relationship", "marking-definition", "identity"]
STIX_SOURCES = ["mitre-attack", "mitre-mobile-attack"]


def read_stix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a STIX bundle; an edge stays if both its ends are nodes.

    Nodes: node_id, external_id (of the first reference to one of `STIX_SOURCES`; a tactic without one has its
    short name), name, type (a flagged technique is a sub-technique), description, platforms,
    phase_names. Edges: src, dst, relation. Objects without an id or a type are left out.
    """
    reference = "array<struct<external_id:string,source_name:string>>"
    own = "x_mitre_is_subtechnique:boolean,x_mitre_shortname:string,x_mitre_platforms:array<string>,kill_chain_phases:array<struct<phase_name:string>>"
    schema = f"objects array<struct<id:string,type:string,name:string,description:string,external_references:{reference},relationship_type:string,source_ref:string,target_ref:string,{own}>>"
    objects = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("objects").alias("o")).select("o.*").filter("id is not null and type is not null")
    kinds = F.create_map(*[F.lit(x) for kv in STIX_TYPES.items() for x in kv])
    kind = F.when((F.col("type") == "attack-pattern") & F.coalesce("x_mitre_is_subtechnique", F.lit(False)), "sub-technique").otherwise(F.coalesce(F.try_element_at(kinds, F.col("type")), F.col("type")))
    first = F.get(F.filter("external_references", lambda r: r["source_name"].isin(STIX_SOURCES)), F.lit(0))["external_id"]
    external = F.when((F.coalesce(first, F.lit("")) == "") & (F.col("type") == "x-mitre-tactic"), F.col("x_mitre_shortname")).otherwise(first)
    none = F.array().cast("array<string>")
    nodes = objects.filter(~F.col("type").isin(STIX_SKIPPED)).select(
        F.col("id").alias("node_id"), external.alias("external_id"), F.coalesce("name", F.lit("")).alias("name"), kind.alias("type"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("x_mitre_platforms", none).alias("platforms"), F.coalesce(F.transform("kill_chain_phases", lambda x: x["phase_name"]), none).alias("phase_names"),
    )
    edges = objects.filter("type = 'relationship'").select(F.col("source_ref").alias("src"), F.col("target_ref").alias("dst"), F.col("relationship_type").alias("relation"))
    ids = nodes.select("node_id")
    kept = edges.join(ids, edges["src"] == ids["node_id"], "left_semi").join(ids, F.col("dst") == ids["node_id"], "left_semi")
    return nodes, kept


def read_threat_intel(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Threat-intelligence documents with their defaults."""
    schema = "id string, name string, description string, entity_type string, confidence double, version string, updated_at string, tags array<string>, references array<string>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    none = F.array().cast("array<string>")
    return raw.filter("id is not null").select(
        F.lit(source).alias("source"), F.col("id").alias("document_id"), F.coalesce("name", "id").alias("title"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("version", F.lit("1.0")).alias("version"), "updated_at",
        F.coalesce("tags", none).alias("tags"), F.coalesce("references", none).alias("references"),
    )


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph snapshot in node-link JSON."""
    raw = spark.read.option("multiLine", True).json(path)
    links = "links" if "links" in raw.columns else "edges"
    return raw.select(F.explode("nodes").alias("n")).select("n.*"), raw.select(F.explode(links).alias("e")).select("e.*")


def load_config(path: str, defaults: dict) -> dict:
    """Settings of a YAML file over the defaults; without a file, the defaults."""
    if not Path(path).exists():
        return dict(defaults)
    import yaml

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}

    def over(a: dict, b: dict) -> dict:
        return a | {k: over(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    return over(defaults, found)
