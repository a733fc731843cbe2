"""Memory of past incidents: their standard schema, filters, changes, and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieval

#: Fields of a stored incident, their types and defaults (fixed values).
LISTS = ["timeline", "evidence", "affected_assets", "attack_techniques", "threat_groups", "malware", "soar_actions", "tags", "references"]
TEXTS = {"resolved_threat": "", "attack_summary": "", "evidence_summary": "", "resolution": "", "recovery_time": "", "lessons_learned": "", "containment_status": "Resolved", "version": "1.0"}
NUMBERS = {"unified_threat_score": 0.0, "confidence": 1.0}
#: From this distance on a hit was not found by its vector.
LEXICAL = 999.0


def complete(df: DataFrame) -> DataFrame:
    """Stored incidents with every field: what a column lacks, or a null in it, is the default."""
    there = set(df.columns)
    made = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in there else F.array().cast("array<string>") for c in LISTS}
    made |= {c: F.coalesce(F.col(c), F.lit(x)) if c in there else F.lit(x) for c, x in (TEXTS | NUMBERS).items()}
    made |= {"timestamp": F.col("timestamp") if "timestamp" in there else F.lit(None).cast("string")}
    return df.withColumns(made)


def standard(df: DataFrame, distance: Column) -> DataFrame:
    """Incidents in the schema that all providers share; `distance`: to the query, 999 without one."""
    i, c = complete(df), F.col
    joined = lambda x: F.array_join(x, ", ")
    groups = F.when(F.size("threat_groups") > 0, joined("threat_groups")).otherwise("Unknown")
    return i.select(
        *[x for x in df.columns if x not in {*LISTS, *TEXTS, *NUMBERS, "timestamp"}], F.lit("historical_incident").alias("source"), c("incident_id").alias("document_id"), c("resolved_threat").alias("title"),
        c("attack_summary").alias("description"), c("attack_summary").alias("summary"), distance.alias("similarity_score"), F.lit(0.0).alias("graph_distance"), F.lit(0).alias("graph_depth"),
        F.when(distance < 990, "vector_search").otherwise("bm25_search").alias("relationship_source"), F.array_join("timeline", " | ").alias("timeline_summary"), c("attack_techniques").alias("mitre_techniques"),
        groups.alias("threat_actor"), c("soar_actions").alias("response_actions"), c("resolution").alias("outcome"), F.concat(F.lit("Historical Incident Recall: "), c("incident_id").cast("string")).alias("citation"),
        *LISTS, *TEXTS, *NUMBERS, "timestamp",
    )


def meets(tags: list[str] | None = None, least_score: float | None = None, technique: str | None = None) -> Column:
    """Whether a (complete) incident meets the filters: any of the tags, a score, a technique; case is ignored."""
    low = lambda c: F.transform(c, F.lower)
    out = F.lit(True)
    if tags is not None:
        out = out & F.arrays_overlap(low("tags"), F.array(*[F.lit(t.lower()) for t in tags]))
    if least_score is not None:
        out = out & (F.col("unified_threat_score") >= least_score)
    if technique is not None:
        out = out & F.array_contains(low("attack_techniques"), technique.lower())
    return F.coalesce(out, F.lit(False))


def insert(df: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Incidents and new ones; these get an id from the time, a time and a version where they lack them."""
    time = F.coalesce(F.col("timestamp"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX")) if "timestamp" in new.columns else F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX")
    id = F.coalesce(F.col("incident_id"), F.concat(F.lit("INC-"), F.unix_timestamp(now).cast("string")))
    version = F.coalesce(F.col("version"), F.lit("1.0")) if "version" in new.columns else F.lit("1.0")
    return df.unionByName(new.withColumns({"timestamp": time, "incident_id": id, "version": version}), allowMissingColumns=True)


def update(df: DataFrame, changed: DataFrame) -> DataFrame:
    """Incidents with those replaced whose id is in `changed`; without a time of its own a change keeps
    the old one. Ids that are not there change nothing."""
    old = df.select("incident_id", F.col("timestamp").alias("_old"))
    time = F.coalesce(F.col("timestamp"), F.col("_old")) if "timestamp" in changed.columns else F.col("_old")
    new = changed.join(old, "incident_id").withColumn("timestamp", time).drop("_old")
    return df.join(new.select("incident_id"), "incident_id", "left_anti").unionByName(new, allowMissingColumns=True).select(df.columns)


def delete(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Incidents without those of the ids."""
    return df.join(gone.select("incident_id").distinct(), "incident_id", "left_anti")


def search(queries: DataFrame, incidents: DataFrame, vector: str, limit: int = 3, where: Column | None = None) -> DataFrame:
    """The best incidents of each query (query_id, text, q): dense and lexical hits fused.

    `incidents`: incident_id, `vector` and any of the stored fields; `where`: one of `meets`. Each
    side ranks only incidents that meet it, while document frequencies are those of all. Result:
    query_id, rank, rrf, method and the standard schema.
    """
    whole = complete(incidents)
    good = whole.filter(where) if where is not None else whole
    text = F.concat_ws(" ", "resolved_threat", "attack_summary", F.array_join("attack_techniques", " "), F.array_join("tags", " "), "resolution", "lessons_learned")
    near = retrieval.dense(queries.select("query_id", "q"), good.select("incident_id", vector), "query_id", "incident_id", vector, limit)
    postings, lengths = retrieval.index(whole.withColumn("_text", text), "incident_id", "_text")
    terms = queries.select("query_id", F.explode(retrieval.tokens(F.col("text"))).alias("term"))
    words = retrieval.bm25(terms, postings, lengths, "query_id", "incident_id", limit, good.select("incident_id"))
    sure = good.select("incident_id", "confidence")
    fused = retrieval.fuse(near.join(sure, "incident_id"), words.join(sure, "incident_id"), ["query_id", "incident_id"])
    best = retrieval.order_fused(fused, "query_id", "incident_id", limit).select("query_id", "incident_id", F.col("place").alias("rank"), "rrf", "method", "distance", F.col("score").alias("bm25_score"))
    return standard(good.drop(vector).join(best, "incident_id"), F.coalesce("distance", F.lit(LEXICAL)))
