import json

import pytest

from msgsearch.plans import alerts
from msgsearch.schemas import ENTITY, RAW_MESSAGE
from msgsearch.session import scratch_dir
from msgsearch.sources import readers
from msgsearch.streaming import live


@pytest.fixture
def dims(spark):
    entities = spark.createDataFrame(
        [(7, "user", "pat", "Pat", None, None), (1, "user", None, "Me", None, None)], ENTITY
    )
    sessions = spark.createDataFrame([(0, "s1", 1)], "pos int, name string, telegram_id bigint")
    chats = spark.createDataFrame([("s1", "@pat"), ("s1", "@gone")], "session_name string, chat_ref string")
    return entities, sessions, chats


def deliver(spark, path, *numbers, chat=7):
    rows = [("s1", chat, n, "message", f"text {n}", 7, None, None, 1000 + n) for n in numbers]
    spark.createDataFrame(rows, RAW_MESSAGE).coalesce(1).write.mode("append").parquet(path)


def numbers(index):
    return sorted(r.message_id for r in index.documents().collect())


def test_redelivery_restart_and_unresolved_chats(spark, new_index, dims):
    index, path, checkpoint = new_index(buckets=2), scratch_dir(spark, "f"), scratch_dir(spark, "c")

    def run():
        stream = readers.stream_messages(spark, path, max_files=1)
        live.start_ingest(stream, index, *dims, checkpoint=checkpoint).awaitTermination()

    deliver(spark, path, 1, 2, 2)
    deliver(spark, path, 2, 3)
    deliver(spark, path, 50, chat=8)
    run()
    assert numbers(index) == [1, 2, 3]
    deliver(spark, path, 1, 2, 3)
    deliver(spark, path, 0, 9)
    run()
    assert numbers(index) == [0, 1, 2, 3, 9]
    assert index.field_stats().filter("field = 'text'").first().n_docs == 5


def test_batch_that_fails_halfway_is_repaired(spark, new_index, dims, monkeypatch):
    index, path, checkpoint = new_index(buckets=2), scratch_dir(spark, "f"), scratch_dir(spark, "c")
    deliver(spark, path, 1, 2)

    def run():
        stream = readers.stream_messages(spark, path)
        live.start_ingest(stream, index, *dims, checkpoint=checkpoint).awaitTermination()

    with monkeypatch.context() as broken:
        broken.setattr(index, "_derive", lambda batch: 1 / 0)
        with pytest.raises(Exception):
            run()
    assert numbers(index) == [] and index.postings().count() == 0
    run()
    assert numbers(index) == [1, 2]
    assert index.postings().filter("field = 'text'").count() == 4


def test_feeds_with_default_names_keep_each_others_batches(spark, new_index, dims):
    index, rejects = new_index(buckets=2), scratch_dir(spark, "r")
    for first in (1, 5):
        path = scratch_dir(spark, "f")
        deliver(spark, path, first, first + 1)
        spark.createDataFrame([("s1", None, first, "message", "x", 7, None, None, 1)], RAW_MESSAGE).write.mode("append").parquet(path)
        stream = readers.stream_messages(spark, path)
        live.start_ingest(stream, index, *dims, checkpoint=scratch_dir(spark, "c"), rejects=rejects).awaitTermination()
    assert numbers(index) == [1, 2, 5, 6]
    assert spark.read.parquet(rejects).count() == 2


def test_counts_of_a_renewed_checkpoint_win(spark, dims):
    path, sink = scratch_dir(spark, "f"), scratch_dir(spark, "s")
    for n in (1, 2, 3):
        rows = [("s1", 7, f"s1:7:{n}")]
        spark.createDataFrame(rows, "session_name string, chat_id bigint, id string").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("session_name string, chat_id bigint, id string").option("maxFilesPerTrigger", 1).parquet(path)
        if n > 1:
            live.start_counts(stream, sink, scratch_dir(spark, "c")).awaitTermination()
    assert live.latest_counts(spark.read.parquet(sink)).first().n_documents == 3


def test_rejects(spark, new_index, dims, tmp_path):
    index, rejects = new_index(buckets=2), scratch_dir(spark, "r")
    good = {"session_name": "s1", "chat_id": 7, "message_id": 1, "kind": "message", "text": "hi", "date": 5}
    lines = [json.dumps(good), json.dumps({**good, "message_id": None}), "{broken", "", json.dumps({**good, "message_id": 2, "date": "soon"})]
    (tmp_path / "feed.json").write_text("\n".join(lines))
    stream = readers.stream_messages(spark, str(tmp_path), "json")
    live.start_ingest(
        stream, index, *dims, checkpoint=scratch_dir(spark, "c"), rejects=rejects
    ).awaitTermination()
    assert numbers(index) == [1]
    found = {r.reason for r in spark.read.parquet(rejects).collect()}
    assert found == {"missing message_id", "unparsable"}


def test_old_messages_survive_deduplication(spark):
    """History arrives newest first; its age must not make it late."""
    path, sink = scratch_dir(spark, "f"), scratch_dir(spark, "s")
    for ids in (("c", "b"), ("b", "a")):
        rows = [(i, 10_000_000 * ord(i)) for i in ids]
        spark.createDataFrame(rows, "id string, date bigint").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("id string, date bigint").option("maxFilesPerTrigger", 1).parquet(path)
    live.start_table(live.dedup(stream, "1 minute"), sink, scratch_dir(spark, "c")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(sink).select("id").collect()) == ["a", "b", "c"]


def test_formats(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_messages(spark, str(tmp_path), "xml")
    (tmp_path / "m.csv").write_text("s1,7,1,message,hi,7,,,5\n")
    row = readers.read_messages(spark, str(tmp_path), "csv").first()
    assert (row.session_name, row.chat_id, row.message_id, row.text) == ("s1", 7, 1, "hi")


def test_alerts_come_once(spark, new_index, dims, monkeypatch):
    """Redelivered messages, a batch that fails after its report, and a second feed into the same index."""
    index, sink = new_index(buckets=2), scratch_dir(spark, "alerts")
    path, checkpoint = scratch_dir(spark, "f"), scratch_dir(spark, "c")
    queries = [("two", "2 nothing", None), ("and", "text-3", "s1"), ("other", "text", "s2"), ("none", "!", None)]
    saved = alerts.saved_clauses(spark.createDataFrame(queries, "search_id string, query string, scope_session_name string"))

    def run(where=path, at=checkpoint):
        stream = readers.stream_messages(spark, where, max_files=1)
        live.start_ingest(stream, index, *dims, checkpoint=at, saved=saved, alerts=sink).awaitTermination()

    def reports():
        return sorted((r.search_id, r.id) for r in spark.read.parquet(sink).select("search_id", "id").collect())

    deliver(spark, path, 1, 2, 2)
    run()
    assert reports() == [("two", "s1:7:2")]
    deliver(spark, path, 2, 3)
    with monkeypatch.context() as broken:
        broken.setattr(index.commits, "publish", lambda state: 1 / 0)
        with pytest.raises(Exception):
            run()
    run()
    other = scratch_dir(spark, "f")
    deliver(spark, other, 3, 2, 22)
    run(other, scratch_dir(spark, "c"))
    assert reports() == [("and", "s1:7:3"), ("two", "s1:7:2")]
