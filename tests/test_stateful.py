"""State across micro-batches: late hours, timers, and batches that come again."""

import uuid

from pyspark.sql import functions as F

from arcspan.operators import graph, identity
from arcspan.sinks import shared_dir
from arcspan.streaming import counters, stateful

HOUR = identity.HOUR_US


def replay(spark, rows, schema, start):
    """Rows, a list for each micro-batch, through `start(stream, checkpoint)`, one file a batch."""
    root = f"{shared_dir(spark.range(1))}/test-{uuid.uuid4().hex}"
    query = None
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        query = start(spark.readStream.schema(schema).parquet(f"{root}/in"), f"{root}/checkpoint")
        query.awaitTermination()
    return query


def test_hours_out_of_order(spark):
    """Batches whose hours overlap and come back to earlier ones give what the whole table gives."""
    batches = [
        [("u", h * HOUR + 60_000_000 * (j * j + 1), f"c{(h * j) % 5}") for h in (0, 2, 4, 6) for j in range(1 + h)] + [(None, 5, "c"), ("u", None, "c")],
        [("u", h * HOUR + 90_000_000 * (j + 1), f"c{j % 7}") for h in (1, 2, 5, 9) for j in range(3)] + [("v", HOUR, None)],
        [("u", 30_000_000, "c4"), ("v", 3 * HOUR, "c1"), ("v", 3 * HOUR, "c1")],
    ]
    schema, got = "user string, us long, computer string", []
    take = lambda df, number: got.extend((number, r) for r in df.collect())
    start = lambda s, at: stateful.behaviour(s, "user", "us", "computer", "30 days").writeStream.outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(take).start()
    replay(spark, batches, schema, start)
    last = {(r["user"], r["window_id"]): r for _, r in sorted(got, key=lambda x: x[0])}
    whole = identity.zscores(identity.user_hours(spark.createDataFrame([r for b in batches for r in b], schema), "user", "us", "computer")).collect()
    assert {(r["user"], r["window_id"]) for r in whole} == set(last)
    for r in whole:
        for name in stateful.FIELDS:
            assert abs(r[name] - last[r["user"], r["window_id"]][name]) < 1e-9, (r["user"], r["window_id"], name)
    assert any(abs(r["auth_count_zscore"]) > 0.1 for r in whole)


def test_closed_hours_take_no_more_rows(spark):
    """Once the watermark has passed an hour its times are given up, and late rows don't change it."""
    schema, got = "user string, us long, computer string", []
    batches = [[("u", 1, "a"), ("u", 2_000_000, "b")], [("u", 9 * HOUR, "a")], [("u", 10 * HOUR, "a")], [("u", 3_000_000, "z"), ("u", 10 * HOUR + 5, "b")]]
    take = lambda df, number: got.extend(df.collect())
    start = lambda s, at: stateful.behaviour(s, "user", "us", "computer", "1 hour").writeStream.outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(take).start()
    query = replay(spark, batches, schema, start)
    assert counters(query)["state_rows"] > 0
    last = {r["window_id"]: (r["auth_count"], r["unique_computers"], r["new_computers"]) for r in got}
    assert last == {0: (2, 2, 2), 9: (1, 1, 0), 10: (2, 2, 0)}


def test_a_batch_counts_once(spark):
    """Batches tried again, before and after they went into the base, leave the merged graph as it is."""
    schema = "detector string, entity string, target string, process string, variable string, risk_score double, confidence double, severity string, us long"
    rows = [("NETWORK", f"h{i % 3}", f"h{i % 4}", None, None, i / 10, 0.5, "HIGH" if i % 2 else "LOW", i) for i in range(9)]
    batches = [spark.createDataFrame(rows[i : i + 2], schema) for i in range(0, 9, 2)]
    tables = stateful.GraphTables(spark, f"{shared_dir(batches[0])}/graph-{uuid.uuid4().hex}", every=3)
    for number, batch in enumerate(batches):
        tables.add(batch, number)
        tables.add(batch, number)
    tables.add(batches[0], 0)
    assert sorted(tables._list()["batch"]) == [0, 1, 2, 3, 4] and tables._list()["base"] == [2]
    found = graph.extract(spark.createDataFrame(rows, schema))
    same = lambda a, b: sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))
    assert same(tables.nodes(), graph.merge_nodes(found)) and same(tables.edges(), graph.merge_edges(found))
    assert tables.nodes().agg(F.sum("observations")).first()[0] == 18
