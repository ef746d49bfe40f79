import zlib
from collections import Counter

import pytest

from msgsearch.llm import feistel_shards as fs


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 7, 10, 63, 64, 1000, 4097])
def test_places_are_a_permutation(rows):
    placed = {fs.place(i, rows, 8) for i in range(rows)}
    assert len(placed) == rows
    assert placed == {(n % 8, n // 8) for n in range(rows)}


def test_assignment_is_computable(texts):
    frame = texts(*[(i * 3, f"t{i}") for i in range(101)])
    rows = sorted(fs.sharded_documents(frame).collect(), key=lambda r: r.doc_id)
    assert [(r.shard, r.slot) for r in rows] == [fs.place(i, 101, 8) for i in range(101)]
    assert rows[5]["size"] == 3 and rows[5].text_crc32 == zlib.crc32(b"t5") and rows[5].law == "rows"
    again = sorted(fs.sharded_documents(frame.repartition(7)).collect(), key=lambda r: r.doc_id)
    assert rows == again


def test_nulls_repeats_and_empty(texts):
    frame = texts((None, None), (1, ""), (1, ""), (1, "é"), (2, "x" * 100_000), extra="5 AS shard")
    rows = fs.sharded_documents(frame).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 5 and max(sizes.values()) == 1
    assert sorted(r["size"] for r in rows) == [1, 1, 1, 3, 100_001]
    assert fs.sharded_documents(frame.where("false")).count() == 0


def test_written_shards_hold_everything(spark, texts, tmp_path):
    frame = texts(*[(i, f"text {i}") for i in range(50)])
    fs.write_shards(frame, ["doc_id"], str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {r.text for r in back.collect()} == {f"text {i}" for i in range(50)}
    assert {r["count"] for r in back.groupBy("shard").count().collect()} <= {12, 13}


def test_stays_native(texts):
    plan = fs.sharded_documents(texts((1, "a")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
