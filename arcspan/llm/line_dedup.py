"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without white space at its ends, A-Z lower-cased; keys shorter than
`length` code points are never dropped. An index holds, for each key that documents refer to,
exact references (key, document) and from these the exact count of documents and the largest one. Keys
with `documents` references and more are repeated: they are in the cuckoo filter of their shard (by
hash of the key), entered when their count reaches the threshold and deleted when it falls below,
which is what a cuckoo filter can and a Bloom filter can't. Documents can be inserted and deleted at
any time, and `clean` always gives what a fresh index of the documents that are in would give.

To clean, the keys of texts go to the shards as 16-byte hashes, the filter lets pass those that may
be repeated (all that are, and about one other in 8,000), and only these are looked up in the exact
tables. So no false hit drops a line. Texts meet their list of dropped keys by the document's id.

Tables are generations of Parquet in one folder: references and counts are logs of what changed, in which
the newest entry of a key counts, and a shard's newest filter holds. A filter that would get too
full is built again, larger, from the exact table. A generation without its end mark does not
exist, so a job that fails or loses executors half-way leaves the index as it was.

Skew: the references of one document to one key are one row; counts are combined before they are
shuffled; filters are copied to `SALTS` parts of their shard, so the rows of a hot line are
spread by document; joins on keys and ids are plain ones, which adaptive execution splits. Nothing
but numbers of generations and shards reaches the driver.

Edge cases: null or empty texts are one empty line. Rows with the same id are one document (each
row is cleaned by itself); rows with a null id are one document that counts as smaller than all
others. Keys are told apart by 128 bits of their sha256. Inserting an id again adds the lines of its new
text. Empty tables change nothing. Other columns are kept by `clean`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Spool, map_arrow
from .cuckoo import HEAD, LOAD, CuckooFilter, buckets_for

#: White space that is stripped; parts of a shard.
SPACE, SALTS = " \t\n\x0b\x0c\r", 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The key of a line."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    """128 bits of a key's sha256."""
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


def lines(text: Column) -> Column:
    """The lines of a text; a null text has one, which is empty."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def references(docs: DataFrame, id: str, text: str, length: int) -> DataFrame:
    """Columns h, doc: each document's distinct long keys."""
    rows = docs.select(F.col(id).cast("long").alias("doc"), F.explode(lines(F.col(text))).alias("line"))
    keys = rows.select("doc", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= length)
    return keys.select(key_hash(F.col("key")).alias("h"), "doc").distinct()


class LineIndex:
    """Lines of the documents that were inserted and not deleted since.

    `path` is a folder that driver and executors share; an index that is there is opened, else one
    begins. Without it the index lives in the folder of `spark.checkpoint.dir` until the driver ends. An
    index must be opened with the thresholds and the number of shards that it began with.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, documents: int = 3, length: int = 20, shards: int = 64):
        self.spark, self.documents, self.length, self.shards = spark, documents, length, shards
        self.spool, self.generation = Spool(spark), 0
        self.path = (path or f"{self.spool.root}/index").rstrip("/")
        while self._there(f"{self.path}/done-{self.generation + 1}/_SUCCESS"):
            self.generation += 1

    def _there(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _log(self, name: str, schema: str) -> DataFrame:
        """All generations of a table."""
        if not self.generation:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}-{g}" for g in range(1, self.generation + 1)))

    def references(self) -> DataFrame:
        """Columns h, doc: the references that hold now."""
        log = self._log("references", "h binary, doc long, stamp long")
        if self.generation == 1:
            return log.filter("stamp % 2 = 1").select("h", "doc")
        return log.groupBy("h", "doc").agg(F.max("stamp").alias("stamp")).filter("stamp % 2 = 1").select("h", "doc")

    def counts(self) -> DataFrame:
        """Columns h, n (documents), largest: the reference counts that hold now; n is 0 where none is left."""
        log = self._log("counts", "h binary, n long, largest long, generation int")
        if self.generation == 1:
            return log.select("h", "n", "largest")
        newest = log.groupBy("h").agg(F.max(F.struct("generation", "n", "largest")).alias("s"))
        return newest.select("h", "s.n", "s.largest")

    def filters(self) -> DataFrame:
        """Columns shard, filter, held: the newest filter of each shard and its number of keys."""
        log = self._log("filters", "shard int, filter binary, held long, generation int")
        newest = log.groupBy("shard").agg(F.max("generation").alias("generation"))
        return log.join(newest, ["shard", "generation"]).select("shard", "filter", "held")

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("h"), F.lit(self.shards)).cast("int")

    def insert(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> None:
        """Add the documents' lines."""
        self._change(references(docs, id, text, self.length), 1)

    def delete(self, docs: DataFrame, id: str = "doc_id") -> None:
        """Take back all lines of the documents with these ids; ids that are not in are ignored."""
        ids = docs.select(F.col(id).cast("long").alias("id")).distinct()
        self._change(self.references().join(ids, F.col("doc").eqNullSafe(F.col("id")), "left_semi"), 0)

    def _change(self, rows: DataFrame, there: int) -> None:
        """Write the next generation: references `rows` now hold (1) or no longer do (0)."""
        g, first = self.generation + 1, not self.generation
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}-{g}")
        write(rows.withColumn("stamp", F.lit(2 * g + there).cast("long")), "references")
        changed = self.spark.read.schema("h binary, doc long, stamp long").parquet(f"{self.path}/references-{g}")
        # A null id is one document below all others: counted by its row, never the largest of several.
        count = [F.count("*").alias("n"), F.max("doc").alias("largest")]
        if first:
            write(changed.groupBy("h").agg(*count).withColumn("generation", F.lit(g)), "counts")
        else:
            keys = changed.select("h").distinct()
            before = self.counts().join(keys, "h", "left_semi").select("h", F.col("n").alias("before"))
            log = self._log("references", "h binary, doc long, stamp long").join(keys, "h", "left_semi").unionByName(changed)
            now = log.groupBy("h", "doc").agg(F.max("stamp").alias("stamp")).filter("stamp % 2 = 1").groupBy("h").agg(*count)
            now = keys.join(now, "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n"), "largest")
            write(now.withColumn("generation", F.lit(g)), "counts")
        after = self.spark.read.schema("h binary, n long, largest long, generation int").parquet(f"{self.path}/counts-{g}")
        least = self.documents
        crossed = after.withColumn("before", F.lit(0)) if first else after.join(before, "h", "left")
        now_in, was_in = F.col("n") >= least, F.coalesce("before", F.lit(0)) >= least
        crossed = crossed.filter(now_in != was_in).select(self._shard().alias("shard"), "h", F.when(now_in, 1).otherwise(-1).alias("way"))
        self._write_filters(self.spool.write(crossed), g, first)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/done-{g}")
        self.generation = g

    def _write_filters(self, crossed: DataFrame, g: int, first: bool) -> None:
        """Change the filters of the shards whose keys crossed the threshold; those too small are built again."""
        moved = crossed.groupBy("shard").agg(F.sum("way").alias("more"))
        old = self.filters().join(moved, "shard").withColumn("size", F.col("held") + F.col("more"))
        full = old.filter(F.col("size") > (F.length("filter") - HEAD) / 2 * LOAD).select("shard")
        kept = old.join(full, "shard", "left_anti")
        columns = ["shard", F.lit(None).cast("binary").alias("filter"), "h", "way"]
        changes = crossed.join(full, "shard", "left_anti").select(*columns)
        if not first:
            # Keys of the shards that grow: what the exact table held before, changed by this generation.
            was = self.counts().filter(F.col("n") >= self.documents).select(self._shard().alias("shard"), "h").join(full, "shard", "left_semi")
            whole = was.withColumn("way", F.lit(1)).unionByName(crossed.join(full, "shard", "left_semi")).groupBy("shard", "h").agg(F.sum("way").alias("way"))
            changes = changes.unionByName(whole.filter("way = 1").select(*columns))
        start = kept.select("shard", "filter", F.lit(None).cast("binary").alias("h"), F.lit(0).alias("way"))
        rows = start.unionByName(changes).repartition("shard").sortWithinPartitions("shard", "way")
        schema = "shard int, filter binary, held long"
        found = map_arrow(rows, _build, schema).withColumn("generation", F.lit(g))
        found.write.mode("overwrite").parquet(f"{self.path}/filters-{g}")
        self.spool.drop(crossed)

    def repeated(self, rows: DataFrame) -> DataFrame:
        """Of references (h, doc), those whose line is repeated and is to go from that document."""
        part = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
        asked = rows.select(self._shard().alias("shard"), part.alias("part"), F.lit(None).cast("binary").alias("filter"), "h", "doc")
        filters = self.filters().select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"), "filter", F.lit(None).cast("binary").alias("h"), F.lit(None).cast("long").alias("doc"))
        both = filters.unionByName(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())
        maybe = map_arrow(both, _probe, "h binary, doc long")
        exact = self.counts().filter(F.col("n") >= self.documents).select("h", "largest")
        return maybe.join(exact, "h").filter(F.col("doc").isNull() | (F.col("doc") < F.col("largest"))).select("h", "doc")

    def clean(self, docs: DataFrame, id: str = "doc_id", text: str = "text", rows: DataFrame | None = None) -> DataFrame:
        """The rows of `docs` with their other columns, the kept text, and n_lines and n_dropped (long).

        Columns of these names are replaced. `rows` may give the documents' references, if they are known.
        """
        gone = self.repeated(references(docs, id, text, self.length) if rows is None else rows)
        gone = gone.groupBy(F.col("doc").alias("doc")).agg(F.collect_list("h").alias("gone"))
        taken = {c.lower() for c in docs.columns}
        free = lambda name: name if name not in taken else free(f"_{name}")
        doc, dropped, hashes, out = free("_doc"), free("_gone"), free("_hashes"), free("_out")
        key = lambda line: F.when(F.char_length(line_key(line)) >= self.length, key_hash(line_key(line)))
        gone = gone.select(F.col("doc").alias(doc), F.col("gone").alias(dropped))
        others = [c for c in docs.columns if c != text and c.lower() not in ("n_lines", "n_dropped")]
        joined = docs.join(gone, F.col(id).cast("long").eqNullSafe(F.col(doc)), "left")
        # Lines are hashed only where something is to go.
        joined = joined.withColumn(hashes, F.when(F.col(dropped).isNotNull(), F.transform(lines(F.col(text)), key)))
        schema = [f for f in docs.schema if f.name in others]
        kept = joined.select(*others, F.coalesce(text, F.lit("")).alias(text), dropped, hashes)
        width = len(schema)

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, n_lines, n_dropped = [], [], []
                for whole, bad, keys in zip(*(batch.column(i).to_pylist() for i in (width, width + 1, width + 2))):
                    if bad is None:
                        texts.append(whole)
                        n_lines.append(whole.count("\n") + 1)
                        n_dropped.append(0)
                        continue
                    bad, parts = set(bad), whole.split("\n")
                    stay = [line for line, k in zip(parts, keys) if k not in bad]
                    texts.append("\n".join(stay))
                    n_lines.append(len(parts))
                    n_dropped.append(len(parts) - len(stay))
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*others, text, "n_lines", "n_dropped"])

        return map_arrow(kept, drop, StructType([*schema, StructField(text, StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())]))


def _hashes(column: pa.Array) -> np.ndarray:
    """The first 64 bits of 16-byte hashes."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8")[::2].copy()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters out of sorted rows (shard, filter, h, way): deletions (-1), the old filter (0), insertions (1)."""
    now, old, ways = None, None, {-1: [], 1: []}

    def done() -> pa.RecordBatch:
        add, less = (np.concatenate([np.zeros(0, np.uint64), *ways[w]]) for w in (1, -1))
        built = CuckooFilter(buckets_for(len(add))) if old is None else CuckooFilter.from_bytes(old)
        built.delete(less)
        built.insert(add)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([built.to_bytes()], pa.binary()), pa.array([built.held], pa.int64())], ["shard", "filter", "held"])

    for batch in batches:
        shards, way = batch.column("shard").to_numpy(), batch.column("way").to_numpy()
        cuts = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (way[1:] != way[:-1])) + 1).tolist(), len(shards)] if len(shards) else []
        for a, b in zip(cuts, cuts[1:]):
            if now is not None and shards[a] != now:
                yield done()
                old, ways = None, {-1: [], 1: []}
            now = int(shards[a])
            if way[a]:
                ways[int(way[a])].append(_hashes(batch.column("h").slice(a, b - a)))
            else:
                old = batch.column("filter")[a].as_py()
    if now is not None:
        yield done()


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that the filter before them lets pass; shards without a filter have no repeated lines."""
    now, held = None, None
    for batch in batches:
        if not len(batch):
            continue
        shards, parts = batch.column("shard").to_numpy(), batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:]):
            some = batch.slice(a, b - a)
            if (shards[a], parts[a]) != now:
                now, held = (shards[a], parts[a]), None
            if some.column("filter")[0].is_valid:
                held = CuckooFilter.from_bytes(some.column("filter")[0].as_py())
                some = some.slice(1)
            if held is not None and len(some):
                yield some.select(["h", "doc"]).filter(pa.array(held.contains(_hashes(some.column("h")))))


def oracle_sql(documents: int = 3, length: int = 20) -> str:
    """The query's rows by DuckDB."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = f"translate(trim(line, {space}), '{UPPER}', '{LOWER}')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, {key} AS k FROM l),
r AS (SELECT k, count(DISTINCT doc_id) + CASE WHEN count(*) > count(doc_id) THEN 1 ELSE 0 END AS n, max(doc_id) AS top FROM k WHERE length(k) >= {length} GROUP BY k),
g AS (SELECT rid, doc_id, i, line, coalesce(n >= {documents} AND (doc_id IS NULL OR doc_id < top), false) AS gone FROM k LEFT JOIN r USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY rid, doc_id"""
