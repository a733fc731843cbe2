"""Licence scan: MinHash bands over overlapping windows of a text, then exact containment.

DataFrame functions only. A text's runs of five words (shingles) are hashed; windows of 16 shingles,
one every 8, cover it whole. A window's signature is that of one-permutation MinHash: the hash
range is cut into `BINS` bands, and each band that has hashes keeps the smallest. A shingle of a
template is its band's minimum in a window that holds it unless one of the window's 15 others falls
into the band below it, so it is found with a probability of at least 1 - 15 / (2 * BINS), 99.98 %.
A template is retrieved by any one of its shingles; a text that matches holds at least 75 % of them,
so a template of n shingles is missed with (15 / (2 * BINS)) ** ceil(0.75 * n) at most: 0.012 % for
the shortest notices (one shingle), nothing that counts for all others. The templates' hashes
(templates are few and fixed) are literals of the plan, so a window that retrieves nothing costs no
row, and words that many texts share retrieve nothing.

What is retrieved is verified exactly over the whole document: of all stretches of the template's
number of shingles plus a quarter, the one that holds most of them must hold 75 %.

Edge cases: null, empty and blank texts, and texts of fewer than five words, match nothing;
repeated rows give repeated results, also under one id or none; an empty table gives an empty
table; columns of the input other than id and text are not used. Templates need five words at least.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import LICENSES

#: Bands, as bits of the hash; shingles from window to window (half a window); words of a shingle; least percentage.
BAND_BITS, STEP, SHINGLE, LEAST = 16, 8, 5, 75
BINS = 1 << BAND_BITS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Signs that are dropped from words (fixed values): quotes, brackets, list and comment marks.
_DROPPED = ".,;:!?()[]{}<>\"'`*#/\\|"


def words(text: str | Column) -> Column:
    """Words of a text, A-Z lower-cased and without marks; of a blank one, an empty word."""
    plain = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _UPPER + _DROPPED, _LOWER)
    return F.split(F.btrim(plain, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")


def shingles(column: str) -> Column:
    """Hashes of runs of five words, in order."""
    w = F.col(column)
    return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))).otherwise(F.array().cast("array<long>"))


def signature(ordered: Column) -> Column:
    """The smallest hash of each band, of hashes in ascending order."""
    band = lambda x: F.shiftright(x, 64 - BAND_BITS)
    return F.filter(ordered, lambda x, i: (i == 0) | (band(x) != band(F.element_at(ordered, F.greatest(i, F.lit(1))))))


def templates(spark: SparkSession, licenses: list[tuple[str, str]]) -> tuple[DataFrame, dict[int, list[int]]]:
    """The template table (t, license, marks: its distinct shingles), and the templates that hold
    each shingle; the number of templates bounds both."""
    rows = [(k, name, text) for k, (name, text) in enumerate(licenses)]
    table = spark.createDataFrame(rows, "t int, license string, text string").withColumn("w", words("text"))
    table = table.select("t", "license", F.array_distinct(shingles("w")).alias("marks"))
    found: dict[int, list[int]] = {}
    local = table.collect()
    for r in local:
        if not r["marks"]:
            raise ValueError("a template has fewer than five words")
        for v in r["marks"]:
            found.setdefault(v, []).append(r["t"])
    return spark.createDataFrame([tuple(r) for r in local], "t int, license string, marks array<long>"), found


def scan(df: DataFrame, licenses: list[tuple[str, str]] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns id, license, containment (of the best template and stretch), first_word (from 0)."""
    spark = df.sparkSession
    known, by_value = templates(spark, licenses or LICENSES)
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), words(text).alias("w"))
    docs = docs.select("row", "id", shingles("w").alias("s"))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size("s") - 1) / STEP), F.lit(0)).cast("int"))
    windows = F.transform(starts, lambda b: F.sort_array(F.slice("s", b * STEP + 1, 2 * STEP)))
    hits = F.flatten(F.transform(windows, lambda x: F.filter(signature(x), lambda v: v.isin(list(by_value)))))
    docs = docs.withColumn("hits", F.array_distinct(hits))
    # A row for each template that a text's bands retrieve. Rows that retrieve none end here, by
    # an explode: a filter would be pushed below the columns above and compute them again.
    lookup = F.from_json(F.lit(json.dumps({str(v): ts for v, ts in by_value.items()})), "map<string,array<int>>")
    found = F.flatten(F.transform("hits", lambda v: F.element_at(lookup, v.cast("string"))))
    met = docs.select("row", "id", "s", F.explode(F.array_distinct(found)).alias("t"))
    met = met.join(F.broadcast(known), "t")
    span = F.size("marks") + F.ceil(F.size("marks") / 4).cast("int")
    at = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.array_contains(F.col("marks"), F.element_at("s", i + 1)))
    met = met.withColumn("at", at).withColumn("span", span)
    held = lambda p: F.size(F.array_intersect(F.slice("s", p + 1, F.col("span")), F.col("marks")))
    # Where too few positions hold a mark at all, no stretch is looked at.
    some = F.when(100 * F.size("at") >= LEAST * F.size("marks"), F.col("at")).otherwise(F.array().cast("array<int>"))
    met = met.withColumn("best", F.array_max(F.transform(some, lambda p: F.struct(held(p).alias("n"), (-p).alias("p")))))
    good = F.filter(F.array("best"), lambda b: 100 * b["n"] >= LEAST * F.size("marks"))
    one = met.select("row", "id", "license", F.size("marks").alias("of"), F.explode(good).alias("b"))
    # Templates of one licence: the best containment, then the earliest stretch.
    best = F.max(F.struct((F.col("b.n") / F.col("of")).alias("containment"), F.col("b.p").alias("p")))
    out = one.groupBy("row", "license").agg(F.first("id").alias("id"), best.alias("b"))
    return out.select(F.col("id").alias(id), "license", F.col("b.containment").alias("containment"), (-F.col("b.p")).cast("long").alias("first_word"))


def oracle_sql(licenses: list[tuple[str, str]] | None = None) -> str:
    """The same by brute force in DuckDB's SQL: every document against every template."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quote(name)}, {quote(text)})" for k, (name, text) in enumerate(licenses or LICENSES))
    plain = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), {quote(_UPPER + _DROPPED)}, {quote(_LOWER)}), '[\\x20\\x09-\\x0D]+'), lambda w: w != '')"
    cut = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))"
    return f"""
WITH t AS (SELECT t, license, {plain} AS w FROM (VALUES {rows}) v(t, license, text)),
m AS (SELECT DISTINCT t, license, unnest({cut}) AS s FROM t),
size AS (SELECT t, count(*) AS n FROM m GROUP BY t),
d AS (SELECT doc_id, {plain} AS w FROM documents),
p AS (SELECT doc_id, unnest({cut}) AS s, unnest(range(0, len(w) - 4)) AS i FROM d WHERE len(w) >= 5),
hit AS (SELECT doc_id, t, license, s, i FROM p JOIN m USING (s)),
best AS (SELECT a.doc_id, a.t, a.license, a.i, count(DISTINCT b.s) AS n
  FROM hit a JOIN size USING (t) JOIN hit b ON a.doc_id = b.doc_id AND a.t = b.t AND b.i >= a.i AND b.i < a.i + size.n + CAST(ceil(size.n / 4.0) AS INT)
  GROUP BY a.doc_id, a.t, a.license, a.i),
good AS (SELECT doc_id, license, best.n / size.n::DOUBLE AS containment, i FROM best JOIN size USING (t) WHERE 100 * best.n >= 75 * size.n)
SELECT doc_id, license, max(containment) AS containment, CAST(min(i) FILTER (WHERE containment = top) AS BIGINT) AS first_word
FROM (SELECT *, max(containment) OVER (PARTITION BY doc_id, license) AS top FROM good) GROUP BY doc_id, license
"""
