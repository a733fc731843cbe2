"""Webhook requests from files, with limits that hold across batches."""

import json
import random
import uuid

import pytest

from arcspan.operators import evidence
from arcspan.sinks import shared_dir
from arcspan.sources import requests
from arcspan.sources.requests import FIELDS, request, stream_requests
from arcspan.streaming.stateful import Receiver

SCHEMA = "id string, kind string, address string, us long, api_key string, content_type string, body string"
SECOND = 1_000_000


def folder(spark):
    root = f"{shared_dir(spark.range(1))}/requests-{uuid.uuid4().hex}"
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/in"))
    return root.removeprefix("file:")


def put(root, name, lines):
    with open(f"{root}/in/{name}", "w", encoding="utf-8") as f:
        f.write("".join(line + "\n" for line in lines))


def run(spark, root, receiver):
    query = stream_requests(spark, f"{root}/in").writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(receiver.add).start()
    query.awaitTermination()
    return query


def rows(n, seed):
    rng, us, out = random.Random(seed), 0, []
    for i in range(n):
        us += rng.choice([0, SECOND, 3 * SECOND, 70 * SECOND if rng.random() < 0.05 else SECOND])
        address = rng.choice(["busy", "busy", "busy", "b", "c", "", None])
        body = rng.choice(["", '{"channel": "x", "src_ip": "1.2.3.4"}', "channel=y&src_ip=5.6.7.8"])
        out.append((f"{i:05d}", "canarytoken", address, us, rng.choice(["k", "k", "no", None]), "application/json" if body.startswith("{") else "form", body))
    return out


def test_limits_hold_across_batches(spark):
    """Whatever the batches, statuses are those of all requests at once; a batch tried again changes nothing."""
    given = rows(240, 1)
    root = folder(spark)
    receiver = Receiver(spark, f"{root}/out", "k", limit=4)
    for n, (a, b) in enumerate([(0, 50), (50, 51), (51, 140), (140, 240)]):
        put(root, f"{n}-a", [json.dumps(dict(zip(FIELDS, r))) for r in given[a : (a + b) // 2]])
        put(root, f"{n}-b", [json.dumps(dict(zip(FIELDS, r))) for r in given[(a + b) // 2 : b]])
        run(spark, root, receiver)
        if n in (1, 3):
            receiver.add(spark.createDataFrame(given[a:b], SCHEMA), n)
    receiver.add(spark.createDataFrame(given[:50], SCHEMA), 0)
    whole = {r["id"]: (r["status"], r["event"]) for r in evidence.received(spark.createDataFrame(given, SCHEMA), "k", 4).collect()}
    got = receiver.events().collect()
    assert len(got) == len(given) and {r["id"]: (r["status"], r["event"]) for r in got} == whole
    assert {s for s, _ in whole.values()} == {200, 400, 401, 429}
    alone = [evidence.received(spark.createDataFrame(given[a:b], SCHEMA), "k", 4).filter("status = 429").count() for a, b in [(0, 50), (50, 51), (51, 140), (140, 240)]]
    assert sum(alone) < sum(s == 429 for s, _ in whole.values())
    assert receiver._states() == [2, 3]
    kept = spark.read.parquet(f"{root}/out/passed/batch=3").groupBy("address").count().collect()
    assert kept and max(r["count"] for r in kept) <= 4


def test_addresses_are_forgotten(spark):
    """What an address had is kept as long as it may count, then given up."""
    root = folder(spark)
    receiver = Receiver(spark, f"{root}/out", limit=1, forget=100)
    one = lambda i, address, s: spark.createDataFrame([(i, "conpot", address, s * SECOND, None, None, "a=b")], SCHEMA)
    for n, (i, address, s) in enumerate([("1", "a", 0), ("2", "b", 50), ("3", "a", 59), ("4", "a", 60), ("5", "b", 400)]):
        receiver.add(one(i, address, s), n)
    assert {r["id"]: r["status"] for r in receiver.events().collect()} == {"1": 200, "2": 200, "3": 429, "4": 200, "5": 200}
    assert [r["address"] for r in spark.read.parquet(f"{root}/out/passed/batch=4").collect()] == ["b"]


def test_files_of_requests(spark):
    """Lines that are no requests, empty files, hidden files, an empty folder, and a file that comes too late."""
    root = folder(spark)
    receiver = Receiver(spark, f"{root}/out")
    run(spark, root, receiver)
    put(root, "5", ["{broken", "[1]", "", json.dumps({"id": 7, "us": "soon", "address": "ü", "body": {"a": 1}, "content_type": "application/json", "extra": 1})])
    put(root, "6", [])
    put(root, ".7", ["hidden"])
    run(spark, root, receiver)
    got = {(r["id"], r["address"], r["us"], r["body"], r["status"]) for r in receiver.events().collect()}
    assert got == {(None, None, None, "{broken", 400), (None, None, None, "[1]", 400), ("7", "ü", None, '{"a": 1}', 200)}
    put(root, "3", ["{}"])
    put(root, "8", ["{}"])
    with pytest.raises(Exception, match="not after"):
        run(spark, root, receiver)
    assert request("null")[-1] == "null" and request('{"us": true}')[3] is None


def test_a_large_file_is_many_tasks(spark, tmp_path, monkeypatch):
    """Each line is read once, wherever ranges cut the file, and a batch's files are read once."""
    monkeypatch.setattr(requests, "BYTES", 37)
    texts = ["", "é" * 30, "no json", *(f'{{"id": "{i}", "us": {i}}}' for i in range(60)), "x" * 200, '{"id": "last"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0").write_text("\n".join(texts), "utf-8")
    reader = requests._Stream(str(tmp_path / "in"))
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) > 20 and [tuple(r.values()) for r in rows] == [request(x) for x in texts if x]
    read = spark.sparkContext.accumulator(0)
    stream = stream_requests(spark, f"file://{tmp_path}/in")

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    receiver = Receiver(spark, f"file://{tmp_path}/out")
    stream.mapInArrow(counted, stream.schema).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(receiver.add).start().awaitTermination()
    assert read.value == receiver.events().count() == len(rows)
