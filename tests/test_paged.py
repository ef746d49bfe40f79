"""Exports in pages: probing, tasks, parsing, and streams that go on at their offset."""

import json

import pytest

from msgsearch.sources import paged, readers
from msgsearch.sources.paged import Export, Pages, stretches
from msgsearch.session import scratch_dir


@pytest.fixture
def export(tmp_path):
    root = tmp_path / "export"

    def add(account, chat, page, *lines, name="part.json"):
        folder = root / f"account={account}" / f"chat={chat}" / f"page={page}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), "utf-8")
        return str(root)

    return add


def message(n, **more):
    return {"message_id": n, "kind": "message", "text": f"text {n}", "date": 1650000000 + n, **more}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 100])
def test_pages_are_counted_by_few_probes(tmp_path, n):
    for page in range(n):
        (tmp_path / "c" / f"page={page}").mkdir(parents=True)
    export, probes = Export(str(tmp_path)), []
    has = export.has
    export.has = lambda chat, page: probes.append(page) or has(chat, page)
    assert export.count("c") == n
    assert len(probes) <= 16
    probes.clear()
    assert export.count("c", n) == n and len(probes) == 1
    assert all(export.count("c", known) == n for known in range(n))


def test_tasks_share_pages():
    end = {"a": 5, "b": 1, "c": 2, "d": 0}
    tasks = stretches({"a": 1}, end, 3)
    assert tasks == [Pages([("a", 1, 4)]), Pages([("a", 4, 5), ("b", 0, 1), ("c", 0, 1)]), Pages([("c", 1, 2)])]
    assert stretches(end, end, 3) == [] == stretches({}, {}, 3)


def test_reading(spark, export, monkeypatch):
    export("north", 1, 0, message(1), message(2, text="a\nb", session_name="other", chat_id=9), "")
    export("north", 1, 1, '{"message_id": 3, "text', message(4, extra=1), name="a.json")
    export("north", 1, 1, message(5), name="b.json")
    export("north", 1, 1, "hidden", name="_SUCCESS")
    export("north", 1, 3, message(99))  # behind a gap: not there yet
    export("so%20uth", "name", 0, message(6, text="天" * 100), message(7, date="x"))
    path = export("empty", 2, 0)
    monkeypatch.setattr(paged, "BATCH", 64)
    for address in (path, f"file:{path}", f"file://{path}"):
        rows = readers.read_pages(spark, address, pages_per_task=1).collect()
        found = sorted((r.message_id, r.session_name, r.chat_id, r.text) for r in rows if r._corrupt_record is None)
        assert found == [
            (1, "north", 1, "text 1"),
            (2, "other", 9, "a\nb"),
            (4, "north", 1, "text 4"),
            (5, "north", 1, "text 5"),
            (6, "so uth", None, "天" * 100),
        ]
    broken = readers.corrupt_rows(readers.read_pages(spark, path)).collect()
    assert sorted(r.payload[:20] for r in broken) == sorted(['{"message_id": 3, "t', json.dumps(message(7, date="x"))[:20]])


def test_nothing_there(spark, tmp_path):
    assert readers.read_pages(spark, str(tmp_path / "none")).count() == 0


def test_a_stream_goes_on_at_its_offset(spark, export):
    """New pages of old chats and new chats come once; a run without any reads nothing."""
    checkpoint, sink = scratch_dir(spark, "ckpt"), scratch_dir(spark, "sink")

    def drain(path):
        rows = readers.stream_pages(spark, path, pages_per_task=2).select("chat_id", "message_id")
        writer = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.chat_id, r.message_id) for r in spark.read.parquet(sink).collect())

    for page in range(5):
        path = export("north", 1, page, message(page))
    first = [(1, n) for n in range(5)]
    assert drain(path) == first
    assert drain(path) == first
    export("north", 1, 5, message(5))
    export("south", 2, 0, message(1), message(2))
    assert drain(path) == [*first, (1, 5), (2, 1), (2, 2)]


def test_pages_are_written_by_the_tasks_that_have_them(spark, tmp_path):
    rows = [("no/rth %=1", "7", n // 2, json.dumps(message(n, text="天\n"))) for n in range(9)]
    rows += [(None, None, 0, json.dumps(message(50))), ("", "a:b", 0, json.dumps(message(60)))]
    path = str(tmp_path / "written")
    for _ in range(2):  # a second writing finds its pages there
        paged.write_pages(spark.createDataFrame(rows, paged.LINE).repartition(3), path)
    export = Export(path)
    assert sorted(export.counts({}).values()) == [1, 1, 5]
    spark.dataSource.register(paged.PagedExport)
    found = sorted((r.account, r.chat, r.page, r.line) for r in spark.read.format(paged.FORMAT).option("path", path).load().collect())
    assert found == sorted((a or paged.MISSING, c or paged.MISSING, p, x) for a, c, p, x in rows)


def test_the_tasks_of_one_read_are_bounded(monkeypatch, tmp_path):
    monkeypatch.setattr(paged, "MOST_TASKS", 10)
    many = {"a": 5_000, "b": 1}
    assert len(paged._Batch({"path": str(tmp_path)}).tasks({}, many)) == 10
    assert len(paged._Batch({"path": str(tmp_path)}).tasks({"a": 4_936, "b": 1}, many)) == 1
    assert len(paged._Batch({"path": str(tmp_path), "pages_per_task": "50"}).tasks({}, many)) == 101
