"""Relational smoke queries on the star schema: joins, sets, grouping, windows, limits.

These are plain declarations that Catalyst plans; the same text runs in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import ORACLES, QUERIES, table

#: Name: SQL that both engines run.
SQL = {
    "rel_join_inner": "SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "rel_join_left": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "rel_join_full": "SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, customers, suppliers FROM (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_nationkey < 20 GROUP BY 1) a FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_nationkey > 3 GROUP BY 1) b ON c_nationkey = s_nationkey",
    "rel_join_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "rel_join_anti": "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)",
    "rel_join_star": "SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    "rel_join_range": "SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND b.p_retailprice > a.p_retailprice AND b.p_retailprice < a.p_retailprice + 5",
    "rel_setop_union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region",
    "rel_setop_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "rel_setop_intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%' INTERSECT SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '5%'",
    "rel_setop_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders",
    "rel_grouping_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "rel_grouping_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rel_grouping_sets": "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())",
    "rel_window_rank": "SELECT o_custkey, o_orderkey, CAST(rk AS INT) AS rk FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) x WHERE rk <= 3",
    "rel_window_lag": "SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders",
    "rel_window_running": "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS running FROM lineitem",
    "rel_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "rel_distinct_agg": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "rel_scalar_subquery": "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "rel_pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _make(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Table functions in the text are bound as parameters: no views are left in the session.
        return spark.sql(sql if not any(t in sql for t in _TABLES) else _bound(sql), **{t: table(spark, sf_dir, t) for t in _TABLES})

    return run


def _bound(sql: str) -> str:
    import re

    return re.sub(r"\b(FROM|JOIN) (" + "|".join(_TABLES) + r")\b", r"\1 {\2}", sql)


for _name, _sql in SQL.items():
    QUERIES[_name] = _make(_sql)
    ORACLES[_name] = _sql


#: Price difference of `rel_join_range`, and the width of its bins, a bit over it.
_BAND, _BIN = 5, 6


def _join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand and size with those that cost up to `_BAND` more.

    Prices are in bins wider than that, so a part's partners are in its own bin or the next one: only rows of two
    bins meet, and a large brand and size is many keys. Prices that 5 can't change (from 1e18) have no partner.
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice").filter(F.abs("p_retailprice") < 1e18)
    bin, keys = F.floor(F.col("p_retailprice") / _BIN), ["p_brand", "p_size", "_bin"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # rows are many more than their bytes tell: no merging of partitions
    a = p.select(F.col("p_partkey").alias("a_key"), "p_brand", "p_size", F.col("p_retailprice").alias("_a"), bin.alias("_bin"))
    b = p.select(F.col("p_partkey").alias("b_key"), "p_brand", "p_size", F.col("p_retailprice").alias("_b"), F.explode(F.array(bin, bin - 1)).alias("_bin"))
    return a.repartition(parts, *keys).join(b.repartition(parts, *keys).hint("merge"), keys).filter((F.col("_b") > F.col("_a")) & (F.col("_b") < F.col("_a") + _BAND)).select("a_key", "b_key")


QUERIES["rel_join_range"] = _join_range
