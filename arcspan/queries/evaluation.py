"""Queries on evaluation: labels against a score of the documents' lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as op
from ..operators import response
from .registry import events, query, table

_L = "l AS (SELECT toxic AS t, (n_chars % 100) / 100 AS s FROM labels JOIN documents USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 100 / 100).alias("s"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("toxic").alias("t"), "s")


_RATES = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(fp / (fp + tn), 6) AS fpr"
_COUNTS = "count(*) FILTER (WHERE t = 1 AND s >= h) AS tp, count(*) FILTER (WHERE t = 0 AND s >= h) AS fp, count(*) FILTER (WHERE t = 0 AND s < h) AS tn, count(*) FILTER (WHERE t = 1 AND s < h) AS fn"


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr")])


@query(f"WITH {_L}, c AS (SELECT {_COUNTS} FROM l, (SELECT 0.5 AS h)) SELECT tp, fp, tn, fn, {_RATES} FROM c")
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion metrics of a decision."""
    return _rounded(op.confusion(_scored(spark, sf_dir), F.col("t"), (F.col("s") >= 0.5).cast("int")))


@query(f"WITH {_L}, r AS (SELECT t, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM l) SELECT round((sum(CASE WHEN t = 1 THEN r END) - count(*) FILTER (WHERE t = 1) * (count(*) FILTER (WHERE t = 1) + 1) / 2) / (count(*) FILTER (WHERE t = 1) * count(*) FILTER (WHERE t = 0)), 6) AS roc_auc FROM r")
def eval_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the ROC curve."""
    return op.roc_auc(_scored(spark, sf_dir), "t", "s").select(F.round("roc_auc", 6).alias("roc_auc"))


@query(f"""WITH {_L}, g AS (SELECT s, sum(t) AS p, count(*) AS n FROM l GROUP BY s), c AS (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS a, sum(p) OVER () AS total FROM g WINDOW w AS (ORDER BY s DESC)),
k AS (SELECT s, tp / a AS pr, tp / total AS re FROM c), d AS (SELECT pr, re - lag(re, 1, 0) OVER (ORDER BY s DESC) AS step, lag(pr, 1, 1) OVER (ORDER BY s DESC) AS last FROM k)
SELECT round(sum(step * pr), 6) AS average_precision, round(sum(step * (pr + last) / 2), 6) AS pr_auc FROM d""")
def eval_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision and the area under the precision-recall curve."""
    a = op.average_precision(_scored(spark, sf_dir), "t", "s")
    return a.select(F.round("average_precision", 6).alias("average_precision"), F.round("pr_auc", 6).alias("pr_auc"))


_TH = [0.5, 0.4, 0.3, 0.2, 0.1]


@query(f"WITH {_L}, c AS (SELECT h AS threshold, {_COUNTS} FROM l, (SELECT unnest([0.5, 0.4, 0.3, 0.2, 0.1]::DOUBLE[]) AS h) GROUP BY h) SELECT threshold, tp, fp, tn, fn, {_RATES} FROM c")
def eval_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics at several thresholds."""
    return _rounded(op.sweep(_scored(spark, sf_dir), "t", "s", _TH), "threshold")


@query("""WITH r AS (SELECT user_id AS q, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS rel FROM events),
g AS (SELECT q, sum(rel) AS t, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS f, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg FROM r GROUP BY q)
SELECT q, round(hits / 10, 6) AS precision, round(CASE WHEN t > 0 THEN hits / t ELSE 0 END, 6) AS recall, round(coalesce(1 / f, 0), 6) AS mrr, round(CASE WHEN t > 0 THEN dcg / list_sum(list_transform(range(1, least(t, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM g""")
def eval_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics of each user's events."""
    from pyspark.sql import Window

    e = events(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).withColumn("rel", (F.col("event_type") == "error").cast("int"))
    out = op.ranking(e.withColumnRenamed("user_id", "q"), "q", "rank", "rel", 10)
    return out.select("q", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


@query("SELECT user_id, list_has_any(list(event_type ORDER BY ts, event_id)[1:1], ['error', 'purchase']) AS top1, list_has_any(list(event_type ORDER BY ts, event_id)[1:3], ['error', 'purchase']) AS top3 FROM events GROUP BY user_id")
def eval_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first predictions match."""
    g = events(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "event_type"))), lambda x: x["event_type"]).alias("p"))
    actual = F.array(F.lit("error"), F.lit("purchase"))
    return g.select("user_id", op.top_matches(F.col("p"), actual, 1).alias("top1"), op.top_matches(F.col("p"), actual, 3).alias("top3"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS auto, count(*) FILTER (WHERE event_type = 'error') AS escalated, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END), 6) AS automation_rate FROM events")
def dashboard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions rolled up."""
    s = F.when(F.col("event_type") == "click", "AUTO").when(F.col("event_type") == "error", "ESCALATE").otherwise("MONITOR")
    return op.roll_up(events(spark, sf_dir).withColumn("s", s), "s").withColumn("automation_rate", F.round("automation_rate", 6))


@query("SELECT CAST(least(floor(value / 50), 9) AS INT) AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 500 GROUP BY 1")
def eval_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by bin."""
    return op.histogram(events(spark, sf_dir), "value", 0.0, 500.0)


@query('SELECT user_id, count(*) AS "count" FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10')
def eval_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent users (a top-k report)."""
    return op.value_counts(events(spark, sf_dir), "user_id", 10)


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'ACTIVE' ELSE 'ESCALATED' END AS status, CAST(row_number() OVER (ORDER BY coalesce(CASE WHEN event_id % 10 != 0 THEN value END, 0) DESC, event_id) AS INT) AS place FROM events WHERE event_type IN ('click', 'error')")
def approval_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents in a state that needs a person, the most urgent first."""
    status = F.when(F.col("event_type") == "click", "ACTIVE").when(F.col("event_type") == "error", "ESCALATED").when(F.col("event_type") == "view", "RESOLVED")
    incidents = events(spark, sf_dir).select("event_id", status.alias("status"), F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("score"))
    return response.approval_queue(incidents, "status", "score", "event_id").select("event_id", "status", "place")
