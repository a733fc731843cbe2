"""Archives read member by member, as streams."""

import io
import json
import tracemalloc
import zipfile

import pytest

from arcspan import sources
from arcspan.sources import archives


def open_of(text):
    return lambda: io.BytesIO(text.encode())


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_records_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(archives, "PIECE", piece)
    read = lambda name, text: list(archives.records(name, open_of(text)))
    values = [{"a": 1234567, "b": {"c": "x]},\"y"}}, {"a": None, "d": [1, {"e": 2}]}, {"f": "ünï\n"}]
    for text in (json.dumps(values), json.dumps(values, indent=3), " \n" + json.dumps(values, ensure_ascii=False) + "\n ", "\n".join(map(json.dumps, values)), "bad\n" + "\n".join(map(json.dumps, values)) + "\n{"):
        assert read("x.json", text) == values
    assert read("x.json", json.dumps(values[0], indent=2)) == values[:1] and read("x.json", "[1, 2.5, {\"a\": 3}, \"s\"]") == [{"a": 3}]
    assert read("x.json", "") == [] and read("x.json", "[]") == [] and read("x.json", "[] x") == [] and read("x.json", '[{"a": 1}, {"a"') == []
    assert read("x.json", '{"a": 1}\n[{"a": 2}]\n{"a": 3}') == [{"a": 1}, {"a": 3}]
    assert read("x.csv", "a,b\n1,\"x\ny\"\n2,z\n") == [{"a": "1", "b": "x\ny"}, {"a": "2", "b": "z"}] and read("x.csv", "") == []
    assert read("x.yaml", "- a: 1\n- b\n") == [{"a": 1}] and read("x.yml", "a: [") == []


def test_members_are_partitions(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.json", json.dumps([{"a": i, "n": {"x": "y"}} for i in range(2500)]))
        z.writestr("d/two.csv", "a\n1\n")
        z.writestr("notes.txt", "no")
        z.writestr("empty.json", "")
    (tmp_path / "broken.zip").write_bytes(b"PK no")
    rows = sources.read_archives(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3
    got = rows.collect()
    assert len(got) == 2501 and {r["path"] for r in got} == {f"file://{tmp_path}/a.zip::d/one.json", f"file://{tmp_path}/a.zip::d/two.csv"}
    assert sorted(int(r["record"]["a"]) for r in got if r["member"] == "d/one.json") == list(range(2500)) and got[0]["record"].get("n.x", "y") == "y"
    one = sources.read_archives(spark, f"{tmp_path}/a.zip::d/two.csv")
    assert one.rdd.getNumPartitions() == 1 and [r["record"] for r in one.collect()] == [{"a": "1"}]


def test_a_member_larger_than_what_is_held(tmp_path):
    """40 MB of one member pass with a few held at any time."""
    path, row = tmp_path / "big.zip", json.dumps({"k": "v" * 990})
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("big.json", "w") as f:
        f.write(b"[")
        for i in range(40_000):
            f.write((("," if i else "") + row).encode())
        f.write(b"]")
    reader = archives._Reader([f"file://{path}"], archives.TELEMETRY, None)
    (part,) = reader.partitions()
    tracemalloc.start()
    assert sum(len(b) for b in reader.read(part)) == 40_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20
