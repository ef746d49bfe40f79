from functools import partial

import pytest

from msgsearch.operators import matching
from msgsearch.plans import grid, requests, search as plans, skipping
from msgsearch.plans.search import batch_search, ranked_searches, search
from msgsearch.schemas import DOCUMENT_COLUMNS
from msgsearch.session import stored
from msgsearch.sources import corpus as corpora
from msgsearch.sources.corpus import IndexCorpus, ScanCorpus
from msgsearch.sources.index_store import Snapshot


@pytest.fixture(params=["scan", "index"])
def corpus(request, new_index):
    """The same documents searched on the fly and through a stored index."""

    def build(*frames):
        if request.param == "scan":
            whole = frames[0]
            for frame in frames[1:]:
                whole = whole.unionByName(frame)
            return ScanCorpus(whole)
        index = new_index(buckets=4)
        for frame in frames:
            index.append(frame)
        return IndexCorpus(index)

    return build


def test_one_word_among_several_messages(corpus, documents):
    source = corpus(documents(dict(text="the pump leaks again"), dict(text="new hose arrived", message_id=2)))
    assert [r.text for r in search(source, "leaks").collect()] == ["the pump leaks again"]
    assert search(source, "drought").isEmpty() and search(source, "?? --").isEmpty()


def test_runs_of_ideographs(corpus, documents):
    source = corpus(documents(dict(text="周末去山里看雪", message_id=2), dict(text="雪 melts", message_id=3)))
    expected = {"看雪": {2}, "雪": {2, 3}, "雪看": set(), "山里看": {2}, "周末 明年": {2}, "末去 melts": {2, 3}}
    for query, numbers in expected.items():
        assert {r.message_id for r in search(source, query).collect()} == numbers, query


def test_scopes(corpus, documents):
    source = corpus(
        documents(
            dict(text="compost order"),
            dict(text="compost delivered", session_name="south", chat_id=4, message_id=2, sender_id=None),
        )
    )

    def ids(**filters):
        return sorted(r.id for r in search(source, "compost", filters=filters).collect())

    both = ["north:8801:1", "south:4:2"]
    assert ids() == both and ids(colour="red") == both
    assert ids(session_name="north") == both[:1] and ids(sender_id=17) == both[:1]
    assert ids(chat_id=4) == both[1:] and ids(session_name="north", chat_id=4) == []


def test_rows_come_back_whole(corpus, documents):
    frame = documents(dict(text="whole row please"))
    row, expected = search(corpus(frame), "whole").first().asDict(), frame.first().asDict()
    assert expected.items() <= row.items()


def test_batches_are_searched_together(corpus, documents):
    parts = [documents(dict(text=f"seed list {n}", message_id=10 * n)) for n in (1, 2, 3)]
    source = corpus(*parts)
    assert search(source, "seed").count() == 3
    assert [r.message_id for r in search(source, "3").collect()] == [30]


def test_newest_come_first(corpus, documents):
    rows = [dict(text="frost warning", date=day, message_id=day) for day in (40, 7, 99, 63)]
    found = search(corpus(documents(*rows)), "frost", limit=3).collect()
    assert [r.date for r in found] == sorted((r.date for r in found), reverse=True) and len(found) == 3


def test_sender_is_matched_whole(corpus, documents):
    source = corpus(documents(dict(text="quiet day", sender_name="OdaBrandt")))
    assert search(source, "OdaBrandt").count() == 1
    assert search(source, "odabrandt").count() == 0
    assert search(source, "Oda").count() == 0


def test_missing_fields(corpus, documents):
    none = dict(sender_id=None, sender_name=None, receiver_name=None, chat_title=None)
    assert search(corpus(documents(none)), "harvest notes").count() == 1


def test_parts_and_fields(corpus, documents):
    source = corpus(
        documents(
            dict(text="red apple", message_id=1, chat_title="fruit"),
            dict(text="red car", message_id=2, chat_title="traffic"),
            dict(text="green", message_id=3, chat_title="apple"),
        )
    )

    def found(query, **options):
        return sorted(r.message_id for r in search(source, query, **options).collect())

    assert found("red-apple") == [1]
    assert found("red apple") == [1, 2, 3]
    assert found("red apple", match="all") == [1]
    assert found("green-apple") == []
    assert found("green apple", match="all") == [3]


def test_repeated_parts_count_twice(corpus, documents):
    source = corpus(documents(dict(text="word here"), dict(text="other", message_id=2)))
    single = search(source, "word").first().score
    assert search(source, "word word").first().score == pytest.approx(2 * single)
    assert search(source, "word-word").first().score == pytest.approx(single)


@pytest.mark.parametrize("match", ["any", "all"])
def test_the_grid_equals_one_bounded_table(spark, corpus, documents, monkeypatch, match):
    rows = [dict(text=f"common word{i % 5} item{i}", message_id=i * 30_000, sender_id=i % 3) for i in range(40)]
    source = corpus(documents(*rows))
    asked = [(i, f"common word{i % 5}" + " item7" * (i % 2), None) for i in range(30)] + [(99, "common " * 40, "north"), (100, "", None)]
    prepared = spark.createDataFrame(asked, "request_id bigint, query string, scope_session_name string")

    def found():
        rows = batch_search(source, prepared, 4, match).collect()
        return sorted((r.request_id, r.rank, r.id, r.score, r.n_results) for r in rows)

    whole = found()
    assert len({r[0] for r in whole}) >= 15
    monkeypatch.setattr(requests, "MAX_ROWS", 4)
    if isinstance(source, IndexCorpus):
        monkeypatch.setattr(corpora, "MOST_FREQUENT", 1)
    assert found() == whole


@pytest.mark.parametrize("match", ["any", "all"])
def test_skipping_equals_reading_everything(spark, new_index, documents, monkeypatch, match):
    """Slabs of very different worth, batches with other average lengths, scopes and ties."""
    index = new_index(buckets=3)
    rows = [
        dict(text="pump " * (i % 7 + 1) + "hose " * (i % 3) + "filler " * (i * 5 % 23), message_id=i * 70_000, chat_id=i % 4, sender_id=i % 2)
        for i in range(80)
    ]
    for n in range(3):
        index.append(documents(*[r | dict(text=r["text"] + "more " * 9 * n) for r in rows[n::3]]), f"b{n}")
    scoped = "search_id string, query string, scope_chat_id bigint, scope_sender_id bigint"
    searches = spark.createDataFrame(
        [("a", "pump", None, None), ("b", "pump-hose", None, None), ("c", "pump hose", 2, None), ("d", "hose nothing", None, 1), ("e", "nothing", None, None)], scoped
    )

    def found(limit):
        return sorted(tuple(r) for r in ranked_searches(IndexCorpus(index), searches, limit, match, True).select("search_id", "id", "score").collect())

    for limit, first, pushed in ((1, 4, 500), (3, 1, 2), (200, 4, 500)):
        plain = found(limit)
        with monkeypatch.context() as eager:
            eager.setattr(plans, "skipping_search", partial(skipping.skipping_search, least_postings=0))
            eager.setattr(skipping, "FIRST", first)
            eager.setattr(skipping, "PUSHED_SLABS", pushed)
            assert found(limit) == plain


def test_skipping_reads_a_tenth_of_a_frequent_word(spark, new_index, monkeypatch):
    """One word in 60,000 messages of 300 chats; the best are in a few of them."""
    index = new_index(buckets=4)
    rows = spark.range(0, 60_000).selectExpr(
        "id % 300 AS chat_id", "id AS message_id", "'north' AS session_name",
        "concat(if(id % 300 < 3, 'word word word word', concat('word ', repeat('filler ', 20 + cast(id % 7 AS int)))), ' ', id) AS text",
        "1L AS sender_id", "'x' AS sender_name", "'y' AS receiver_name", "id AS date", "'t' AS chat_title",
    )
    rows = rows.selectExpr("concat(session_name, ':', chat_id, ':', message_id) AS id", "*")
    index.append(rows.select(*DOCUMENT_COLUMNS))
    corpus, read = IndexCorpus(index), []
    scored = matching.score

    def counting(found, *rest):
        read.append(found.count())
        return scored(found, *rest)

    monkeypatch.setattr(matching, "score", counting)
    want = [tuple(r) for r in search(corpus, "word", 20).collect()]
    everything = sum(read)
    monkeypatch.setattr(plans, "skipping_search", partial(skipping.skipping_search, least_postings=0))
    read.clear()
    assert [tuple(r) for r in search(corpus, "word", 20).collect()] == want and len(want) == 20
    assert everything == 60_000 and 0 < sum(read) <= everything / 10


def test_a_large_table_reads_the_postings_once(spark, new_index, documents, monkeypatch):
    index = new_index(buckets=2)
    index.append(documents(*[dict(message_id=i, text=f"common item{i}") for i in range(50)]))
    prepared = spark.createDataFrame([(i, f"common item{i}") for i in range(60)], "request_id bigint, query string")
    monkeypatch.setattr(requests, "MAX_ROWS", 5)
    reads = []
    whole = Snapshot._read
    monkeypatch.setattr(Snapshot, "_read", lambda self, kind: reads.append(kind) or whole(self, kind))
    assert batch_search(IndexCorpus(index), prepared, 3).count() == 50 * 3 + 10 * 3
    assert reads.count("postings") == 1 and reads.count("documents") == 1


def test_scope_comes_before_the_cut(corpus, documents):
    rows = [dict(text="weed", message_id=i) for i in range(40)]
    rows += [dict(text="weed and many more words here", message_id=i, session_name="south") for i in range(3)]
    assert search(corpus(documents(*rows)), "weed", 3, {"session_name": "south"}).count() == 3


def test_unknown_options(documents):
    with pytest.raises(ValueError):
        search(ScanCorpus(documents({})), "a", match="some")


@pytest.mark.parametrize("match", ["any", "all"])
def test_cells_make_no_row_for_a_search_and_a_document(spark, documents, monkeypatch, match):
    """Ties, rows of one key, scopes, parts of several words: as from one bounded table, and only the best leave a cell."""
    rows = [dict(text=f"common word{i % 3} item{i % 11} red-car", message_id=i // 2 * 2 if i < 20 else i, chat_id=i % 2, sender_id=i % 3, session_name="n:1" if i % 4 else "north") for i in range(120)]
    source = ScanCorpus(documents(*rows))
    asked = [(i, f"common red-car word{i % 3}-item{i % 11} garden common", None, i % 2 if i % 3 else None, i % 3 if i % 5 == 0 else None) for i in range(60)] + [(97, "club", "n:1", None, None), (98, "absent", None, None, None)]
    searches = spark.createDataFrame(asked, "search_id string, query string, scope_session_name string, scope_chat_id bigint, scope_sender_id bigint")

    def found(bounded):
        hits = ranked_searches(source, searches, 4, match, bounded).collect()
        return sorted((r.search_id, r.id, r.text, r.sender_id, r.score) for r in hits)

    written = {}

    def keep(rows, label):
        written[label] = rows._jdf.queryExecution().executedPlan().toString()
        return stored(rows, label)

    monkeypatch.setattr(grid, "stored", keep)
    assert found(False) == found(True) != []
    assert "FlatMapCoGroupsInArrow" in written["best"] and "search_id" not in "".join(x for x in written["best"].splitlines() if "Join" in x)
