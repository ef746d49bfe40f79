import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from msgsearch.operators import enrich, ingest, resolve
from msgsearch.operators.gaps import chat_gaps
from msgsearch.plans.search import search
from msgsearch.schemas import DOCUMENT, DOCUMENT_COLUMNS, ENTITY, RAW_MESSAGE
from msgsearch.sources import commits
from msgsearch.sources.corpus import IndexCorpus
from msgsearch.sources.index_store import _TABLES, MessageIndex
from workload import registry


def ids(frame):
    return sorted(r.id for r in frame.select("id").collect())


def test_state_over_its_life(spark, new_index, documents):
    index = new_index(buckets=3)
    assert index.is_open() and index.live_batches() == []
    notes = documents(*[dict(message_id=n, text=f"plot {n} watered today") for n in (3, 8, 11)])
    assert index.append(notes.limit(0)) == 0
    assert [index.append(notes), index.append(notes)] == [3, 0]
    assert index.document_exists("north:8801:8") and not index.document_exists("north:8801:9")
    stats = {r.field: (r.n_docs, r.total_len) for r in index.field_stats().collect()}
    assert stats == {"text": (3, 12), "chat_title": (3, 6), "sender_name": (3, 3)}
    with pytest.raises(ValueError):
        index.reset()
    index.reset(confirm=True)
    assert index.document_count() == 0 and index.postings().isEmpty()
    assert index.append(notes) == 3


def test_a_committed_batch_is_final(new_index, documents, monkeypatch):
    index = new_index(buckets=4)
    first, second = documents(dict(message_id=1), dict(message_id=2)), documents(dict(message_id=3, text="late"))
    assert index.append(first, "a") == 2
    monkeypatch.setattr(index, "_derive", lambda part: 1 / 0)
    assert index.append(second, "a") == 0
    monkeypatch.undo()
    assert ids(index.documents()) == ["north:8801:1", "north:8801:2"]
    assert {r.message_id for r in search(IndexCorpus(index), "harvest").collect()} == {1, 2}
    index.append(second, "b")
    index.compact()
    index.vacuum()
    assert index.append(documents(dict(message_id=9)), "a") == 0 and index.append(second, "b") == 0
    assert index.field_stats().filter("field = 'text'").first().n_docs == 3


def test_names_outlive_many_mergings(new_index, documents, monkeypatch):
    monkeypatch.setattr(commits, "FOLDERS", 2)
    index = new_index(buckets=1)
    for n in range(5):
        assert index.append(documents(dict(message_id=n)), f"b{n}") == 1
        index.compact()
    state = index.commits.read()
    assert len(state.folders) <= 2 and len(state.live) == 1 and len(state.names) <= 1
    assert [index.append(documents(dict(message_id=50)), f"b{n}") for n in range(5)] == [0] * 5
    assert index.append(documents(dict(message_id=50)), "b5") == 1


def test_a_snapshot_stays_the_same(new_index, documents):
    index = new_index(buckets=2)
    index.append(documents(dict(message_id=1, text="old seed")), "a")
    index.append(documents(dict(message_id=2, text="old seed")), "b")
    corpus = IndexCorpus(index).pinned()
    index.append(documents(dict(message_id=3, text="new seed seed")), "c")
    index.compact()
    assert [r.message_id for r in search(corpus, "seed").collect()] == [1, 2]
    assert corpus.index.field_stats().filter("field = 'text'").first().n_docs == 2
    assert corpus.index.document_count() == 2 and index.document_count() == 3
    assert search(IndexCorpus(index), "seed").count() == 3


def test_two_writers_give_each_id_once(new_index, documents):
    index = new_index(buckets=2)
    rows = documents(*[dict(message_id=i, chat_id=i % 3) for i in range(90)])
    wait = threading.Barrier(3)

    def write(name, frame):
        wait.wait()
        return index.append(frame, name)

    with ThreadPoolExecutor(3) as pool:
        frames = [rows, rows.filter("message_id >= 30"), rows.filter("message_id < 60")]
        counts = list(pool.map(write, "abc", frames))
    assert sum(counts) == 90 and index.document_count() == 90
    found = ids(index.documents())
    assert len(found) == len(set(found)) == 90
    assert index.postings().count() == 90 * 5
    assert index.field_stats().filter("field = 'text'").first().n_docs == 90
    assert index.live_batches() == sorted(index.commits.read().live)


def test_the_same_batch_from_two_writers_counts_once(new_index, documents):
    index = new_index(buckets=2)
    frame = documents(dict(message_id=1), dict(message_id=2))
    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(lambda _: index.append(frame, "same"), range(2))) == [0, 2]
    assert index.document_count() == 2


def test_a_number_is_published_once(new_index):
    log = new_index(buckets=1).commits
    state = log.read()
    assert log.publish(state.with_part("x", 1, "first")) and not log.publish(state.with_part("y", 1, "second"))
    assert log.read().parts() == ["x"] and log.holds(log.read(), "first") and not log.holds(log.read(), "second")


def test_another_reader_sees_what_was_committed(spark, new_index, documents):
    index = new_index(buckets=2)
    index.append(documents(dict(message_id=1)))
    other = MessageIndex(spark, index.path, f"other_{index.name}").open()
    index.append(documents(dict(message_id=2)))
    assert ids(other.documents()) == ["north:8801:1", "north:8801:2"]
    assert other.append(documents(dict(message_id=2), dict(message_id=3))) == 1
    assert index.document_count() == 3 and index.postings().count() == 15


def test_failed_writes_can_be_cleared(new_index, documents, monkeypatch):
    index = new_index(buckets=1)
    index.append(documents(dict(message_id=1)), "a")
    with monkeypatch.context() as broken:
        broken.setattr(index, "_tops", lambda part: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.append(documents(dict(message_id=2)), "b")
    assert index.vacuum() == 0 and index.vacuum(abandoned=True) == 1
    assert index.append(documents(dict(message_id=2)), "b") == 1 and index.document_count() == 2


def rows_read(frame, table):
    """Rows that the scans of a table have given in the last run of a plan."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf.plan() if "QueryStage" in leaf.nodeName() else leaf
        inner = leaf.collectLeaves()
        for j in range(inner.size()):
            if table in inner.apply(j).nodeName():
                total += inner.apply(j).metrics().apply("numOutputRows").value()
    return total


def test_the_cost_of_an_append_does_not_follow_the_archive(spark, new_index):
    """Ids of a batch are looked up in the slabs that it touches, whatever else there is."""
    from msgsearch.schemas import DOCUMENT_COLUMNS

    def messages(chats, many):
        rows = spark.range(0, many * len(chats)).withColumn("chat_id", F.element_at(F.array(*map(F.lit, chats)), (F.col("id") % len(chats) + 1).cast("int")))
        rows = rows.withColumn("message_id", F.floor(F.col("id") / len(chats)).cast("bigint"))
        values = {"session_name": "'north'", "text": "'a note'", "sender_id": "1L", "sender_name": "'x'", "receiver_name": "'y'", "date": "1L", "chat_title": "'t'"}
        rows = rows.selectExpr("chat_id", "message_id", *[f"{v} AS {k}" for k, v in values.items()])
        return rows.selectExpr("concat(session_name, ':', chat_id, ':', message_id) AS id", "*").select(*DOCUMENT_COLUMNS)

    index = new_index(buckets=2)
    index.append(messages([1], 4000), "small")
    batch = index._write_documents(messages([1], 100))
    before = rows_read(index._known(batch, index.live_batches()), "id_words")
    index.append(messages(list(range(2, 202)), 4000), "large")
    after = rows_read(index._known(batch, index.live_batches()), "id_words")
    assert index._known(batch, index.live_batches()).count() == 2
    assert before and after <= 3 * before and index.id_words().count() > 100 * before


def test_gaps_across_slabs_and_groups(documents):
    numbers = [-9, -3, -2, 0, 1, 7, 8, 9, 15, 16, 40, 41, 42, 300]
    frame = documents(*[dict(message_id=n) for n in numbers], dict(message_id=5, chat_id=1))
    want = [(a, b, b - a - 1) for a, b in zip(numbers, numbers[1:]) if b - a > 1]
    for bits, group in ((16, 22), (2, 22), (2, 1), (0, 3)):
        found = chat_gaps(frame.select("session_name", "chat_id", "message_id"), bits, group)
        assert sorted((r.after_id, r.before_id, r.n_missing) for r in found.collect()) == want, (bits, group)
    assert chat_gaps(frame.unionByName(frame).select("session_name", "chat_id", "message_id")).count() == len(want)


def test_reopened_over_existing_files(spark, new_index, documents):
    index = new_index(buckets=4)
    index.append(documents({}))
    for kind in _TABLES:
        spark.sql(f"DROP TABLE {index.table_name(kind)}")
    assert not index.is_open()
    again = MessageIndex(spark, index.path, index.name).open()
    assert again.buckets == 4 and again.document_count() == 1 and again.postings().count() == 5
    again.refresh()
    assert again.document_count() == 1
    with pytest.raises(ValueError, match="4 buckets"):
        MessageIndex(spark, index.path, "other", 8).open()


def test_failed_batch_is_invisible_and_new_again(new_index, documents, monkeypatch):
    index = new_index(buckets=2)
    frame = documents(dict(message_id=1), dict(message_id=2))
    with monkeypatch.context() as broken:
        broken.setattr(index, "_derive", lambda part: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.append(frame)
    assert index.document_count() == 0
    assert index.append(frame) == 2
    assert index.document_count() == 2 and index.postings().count() == 10


def test_merging_changes_nothing(new_index, documents):
    index = new_index(buckets=2)
    for n in range(4):
        index.append(documents(dict(message_id=n, text=f"bed {n} of many")), f"b{n}")
    before = sorted(map(str, index.postings().collect()))
    lengths = sorted(map(str, index.field_stats().collect()))
    assert index.compact() == 4 and len(index.live_batches()) == 1
    assert sorted(map(str, index.postings().collect())) == before
    assert sorted(map(str, index.field_stats().collect())) == lengths
    assert index.vacuum() == 4 and index.compact() == 1
    assert sorted(map(str, index.postings().collect())) == before
    assert index.append(documents(dict(message_id=2)), "b2") == 0
    assert index.append(documents(dict(message_id=9)), "b9") == 1
    assert index.document_count() == 5


def test_large_batch_way_equals_small_batch_way(documents):
    indexed = documents(*[dict(message_id=i) for i in range(0, 20, 3)])
    frame = documents(*[dict(message_id=i) for i in range(20)])
    want = [f"north:8801:{i}" for i in range(20) if i % 3]
    for small in (True, False):
        assert ids(ingest.new_by_id(frame, indexed, small)) == sorted(want)


def test_marks_leave_out_holes(documents):
    frame = documents(*[dict(message_id=i) for i in range(1, 9)])
    whole, holes = frame.filter("message_id <= 5"), frame.filter("message_id in (2, 5)")
    assert ids(ingest.beyond_marks(frame, whole)) == ids(ingest.new_by_id(frame, whole))
    assert len(ids(ingest.new_by_id(frame, holes))) == 6
    assert len(ids(ingest.beyond_marks(frame, holes))) == 3


def test_dedupe_keeps_the_earliest_of_many_copies(documents):
    copies = documents({}).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(999))))
    copies = copies.withColumn("date", F.col("date") + F.col("n") % 10).drop("n")
    kept = ingest.dedupe_by_id(copies.unionByName(documents(dict(message_id=2)))).collect()
    assert sorted((r.id, r.date) for r in kept) == [("north:8801:1", 1650000000), ("north:8801:2", 1650000000)]


SESSION = "pos int, name string, telegram_id bigint, included_chats array<string>"


@pytest.fixture
def entities(spark):
    rows = [
        (4455667788, "channel", None, None, None, "Harbour Watch"),
        (60221, "user", None, "Pat", "Lee", None),
        (31415, "user", "kimdoe", "Kim", None, None),
        (27182, "user", None, "Own", "Er", None),
    ]
    return spark.createDataFrame(rows, ENTITY)


def sessions(spark, *refs):
    return spark.createDataFrame([(0, "desk", 27182, list(refs))], SESSION)


def test_chat_resolution(spark, entities):
    chats = resolve.explode_chats(sessions(spark, "-1004455667788", "60221", "@kimdoe", "@gone"))
    found = {r.chat_ref: r.chat_id for r in resolve.resolve_refs(chats, entities).collect()}
    assert found == {"-1004455667788": 4455667788, "60221": 60221, "@kimdoe": 31415, "@gone": None}
    assert resolve.followed_sessions(chats, entities).first().n_chats == 3
    assert [r.chat_ref for r in resolve.unresolved_refs(chats, entities).collect()] == ["@gone"]


def test_no_chat_resolved(spark, entities):
    chats = resolve.explode_chats(sessions(spark, "@gone", "5"))
    assert resolve.followed_sessions(chats, entities).count() == 0


def test_a_chat_named_twice_counts_once(spark, entities):
    chats = resolve.explode_chats(sessions(spark, "@kimdoe", "31415", "@KimDoe"))
    assert resolve.followed_sessions(chats, entities).first().n_chats == 1


def test_sessions_are_required(spark):
    with pytest.raises(ValueError):
        resolve.require_sessions(spark.createDataFrame([], SESSION))


def test_entities_listed_twice_do_not_double_messages(spark, entities):
    twice = resolve.unique_entities(entities.unionByName(entities.replace({"Pat": "Patricia"}, subset="first_name")))
    accounts = sessions(spark, "60221", "@kimdoe")
    rows = [("desk", 60221, 1, "message", "once", 60221, None, None, 10)]
    found = enrich.enrich(spark.createDataFrame(rows, RAW_MESSAGE), twice, accounts, resolve.explode_chats(accounts))
    assert [(r.sender_name, r.chat_title) for r in found.collect()] == [("Pat Lee", "Pat")]


def test_enrichment_rules(spark, entities):
    rows = [
        ("desk", 60221, 1, "message", "to them", 27182, None, None, 10),
        ("desk", 60221, 2, "message", "to me", 60221, None, None, 20),
        ("desk", 4455667788, 3, "message", "   ", 0, 4455667788, None, None),
        ("desk", 60221, 4, "message", "", 27182, None, None, 40),
        ("desk", 60221, 5, "message", None, 27182, None, None, 50),
        ("desk", 60221, 6, "service", "joined", 27182, None, None, 60),
        ("desk", 16180, 7, "message", "elsewhere", 27182, None, None, 70),
        ("lab", 60221, 8, "message", "not mine", 27182, None, None, 80),
        ("desk", 60221, None, "message", "no key", 27182, None, None, 90),
        ("desk", 31415, 9, "message", "stranger", 777, None, None, 95),
    ]
    raw = spark.createDataFrame(rows, RAW_MESSAGE)
    accounts = sessions(spark, "-1004455667788", "60221", "@kimdoe", "@gone")
    found = enrich.enrich(raw, entities, accounts, resolve.explode_chats(accounts))
    assert found.columns == DOCUMENT_COLUMNS
    got = {r.message_id: r for r in found.collect()}
    assert sorted(got) == [1, 2, 3, 9]
    assert (got[1].sender_name, got[1].receiver_name) == ("Own Er", "Pat")
    assert (got[2].sender_name, got[2].receiver_name) == ("Pat Lee", "Own Er")
    assert (got[3].sender_id, got[3].sender_name, got[3].receiver_name) == (4455667788, "Harbour Watch", "Harbour Watch")
    assert (got[3].text, got[3].date) == ("   ", 0)
    assert (got[9].sender_id, got[9].sender_name, got[9].chat_title) == (777, None, "Kim")
    rejected = enrich.rejected_rows(raw).collect()
    assert [r.reason for r in rejected] == ["missing message_id"]


def test_chat_without_messages_resolves(spark, entities):
    accounts = sessions(spark, "-1004455667788")
    chats = resolve.explode_chats(accounts)
    empty = enrich.enrich(spark.createDataFrame([], RAW_MESSAGE), entities, accounts, chats)
    assert empty.count() == 0
    assert resolve.resolved_chats(chats, entities).first().chat_id == 4455667788


def test_counts(spark, documents):
    frame = documents(dict(message_id=1), dict(message_id=4), dict(message_id=2, chat_id=7))
    counts = {(r.session_name, r.chat_id): r.n_documents for r in ingest.ingest_counts(frame).collect()}
    assert counts == {("north", None): 3, ("north", 8801): 2, ("north", 7): 1}
    cover = {r.chat_id: r.percent for r in ingest.chat_coverage(frame).collect()}
    assert cover == {8801: 75.0, 7: 0.0}
    asked = spark.createDataFrame([("north:8801:1",), ("north:8801:9",)], "id string")
    assert {r.id: r.exists for r in ingest.documents_exist(asked, frame).collect()} == {
        "north:8801:1": True,
        "north:8801:9": False,
    }
    assert ingest.filter_documents(frame, "north", chat_id=7).count() == 1
    assert ingest.document_count(spark.createDataFrame([], DOCUMENT)).first()[0] == 0


def test_workload_indexes_have_buckets_in_proportion(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "ROWS_PER_BUCKET", 10)
    for name, many, least in (("few", 25, 8), ("many", 95, 10)):
        spark.range(many).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        index = registry._new_index(spark, f"{tmp_path}/{name}")
        assert index.buckets == least
    assert registry._buckets(spark, f"{tmp_path}/few", "conversations", 3) == 3
