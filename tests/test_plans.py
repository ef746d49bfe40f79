"""The physical plans, as far as scale depends on them."""

import re

import pytest
from pyspark.sql import functions as F

from msgsearch.functions.literals import any_of
from msgsearch.operators import enrich, matching, postings
from msgsearch.operators.resolve import explode_chats
from msgsearch.operators.sequence import message_sequence
from msgsearch.operators.topk import top_k
from msgsearch.plans import grid, requests as rq
from msgsearch.plans.search import batch_search, ranked_searches, search
from msgsearch.schemas import ENTITY, REQUEST, SESSION
from msgsearch.session import scratch_dir, stored
from msgsearch.sources import corpus as corpora
from msgsearch.sources.corpus import IndexCorpus, ScanCorpus


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def details(frame) -> str:
    """The plan with its scans in full."""
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


def final(frame) -> str:
    frame.collect()
    return plan(frame).split("Initial Plan")[0]


@pytest.fixture
def many(documents):
    rows = [dict(message_id=i, text=f"word{i % 7} common", sender_id=i % 3) for i in range(60)]
    return documents(*rows)


@pytest.fixture
def index(new_index, many):
    built = new_index(buckets=4)
    built.append(many)
    return built


SCOPED = "search_id string, query string, scope_session_name string"


def test_postings_are_built_without_shuffle(index):
    assert "Exchange" not in plan(postings.postings(index._part("documents", _batch(index))))


def _batch(index):
    return index.live_batches()[0]


def test_matching_in_the_index_shuffles_no_postings(spark, index):
    searches = spark.createDataFrame([("a", "word1 common", "north")], SCOPED)
    wanted = matching.clauses(searches)
    found, weights = IndexCorpus(index).lookup(wanted, bounded=True)
    text = plan(matching.score(found, wanted, weights, bounded=True))
    assert "hashpartitioning(search_id" not in text
    assert not re.search(r"Exchange hashpartitioning\(.*message_id", text)
    text = details(found)
    assert "Or(EqualTo(term,common),EqualTo(term,word1))" in text and "EqualTo(session_name,north)" in text


def test_best_hits_are_cut_before_the_shuffle(many):
    text = plan(top_k(many, ["chat_id"], [F.desc("date"), F.asc("id")], 10, "id"))
    assert text.count("WindowGroupLimit") == 2


def test_few_hits_are_fetched_by_bucket_and_id(spark, index):
    hits = spark.createDataFrame([("north:8801:7", 1)], "id string, micro bigint")
    frame = IndexCorpus(index).fetch(hits, bounded=True)
    assert re.search(r"PushedFilters: .*EqualTo\(slab,-?\d+\), EqualTo\(id,north:8801:7\)", details(frame))
    assert frame.count() == 1


def test_many_hits_meet_documents_where_they_lie(spark, index):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = spark.createDataFrame([("north:8801:7", 1)], "id string, micro bigint")
        text = plan(IndexCorpus(index).fetch(hits, bounded=False))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1


def test_positions_in_the_index_rank_without_shuffle(index):
    text = plan(message_sequence(IndexCorpus(index).message_keys()))
    assert not re.search(r"Exchange hashpartitioning\(slab", text)
    assert "text#" not in text


@pytest.mark.parametrize("kind", ["scan", "index"])
def test_batch_search_plan(spark, many, index, kind):
    corpus = ScanCorpus(many) if kind == "scan" else IndexCorpus(index)
    requests = spark.createDataFrame([(1, 5, "common word3"), (2, 6, "word1")], REQUEST)
    sessions = spark.createDataFrame(
        [(0, "north", 5), (1, "north", 6)], "pos int, name string, telegram_id bigint"
    )
    frame = batch_search(corpus, rq.prepare(requests, sessions, unknown_user="none"))
    text = plan(frame)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow"):
        assert node not in text
    assert frame.count() == 19


def test_equal_requests_are_answered_once(spark):
    rows = [(n, 5, "same question") for n in range(50)] + [(99, 5, "another")]
    sessions = spark.createDataFrame([(0, "north", 5)], "pos int, name string, telegram_id bigint")
    prepared = rq.prepare(spark.createDataFrame(rows, REQUEST), sessions, unknown_user="none")
    assert rq.distinct_searches(rq.search_key(prepared)).count() == 2


def test_scan_shuffles_postings_once(many):
    text = final(search(ScanCorpus(many), "common word2", 5))
    assert "ReusedExchange" in text


def test_large_request_tables_are_not_broadcast(spark, monkeypatch, many):
    requests = spark.createDataFrame([(n, f"common word{n % 7}") for n in range(5)], "request_id bigint, query string")
    assert rq.is_bounded(requests)
    monkeypatch.setattr(rq, "MAX_ROWS", 3)
    assert not rq.is_bounded(requests)
    written = []

    def keep(rows, label):
        written.append((label, rows._jdf.queryExecution().analyzed().toString()))
        return stored(rows, label)

    monkeypatch.setattr(grid, "stored", keep)
    assert batch_search(ScanCorpus(many), requests, limit=4).count() == 20
    plans = dict(written)
    # Only the table of three fields is sent to every task.
    assert {k: p.count("strategy=broadcast") for k, p in plans.items()} == {"clauses": 0, "weights": 1, "best": 0}


def test_cells_meet_without_another_shuffle(spark, monkeypatch, index):
    """Postings and clauses are dealt to cells once; matching, scoring and the cut happen there."""
    plans = {}

    def keep(rows, label):
        plans[label] = plan(rows)
        return stored(rows, label)

    monkeypatch.setattr(grid, "stored", keep)
    searches = spark.createDataFrame([("a", "word1 common"), ("b", "common-word2")], "search_id string, query string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert ranked_searches(IndexCorpus(index), searches, 5).count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(cell", plans["best"])) == 2
    assert not re.search(r"Exchange hashpartitioning\(.*message_id", plans["best"])
    assert plans["best"].count("WindowGroupLimit") == 2


def test_a_large_vocabulary_is_not_sent_to_tasks(spark, monkeypatch, index):
    """Files of terms and hits look small to Spark; only frequent terms and few hits are broadcast."""
    searches = spark.createDataFrame([("a", "word1 common"), ("b", "common-word2"), ("c", "word5")], "search_id string, query string")
    plans = {}

    def keep(rows, label):
        plans[label] = plan(rows)
        return stored(rows, label)

    def found():
        hits = ranked_searches(IndexCorpus(index), searches, 5)
        text = plan(hits)
        return sorted((r.search_id, r.id, r.score) for r in hits.collect()), text

    monkeypatch.setattr(grid, "stored", keep)
    few, text = found()
    assert len(few) == 15 and "SortMergeJoin" not in plans["best"] + text
    monkeypatch.setattr(corpora, "MOST_FREQUENT", 2)
    monkeypatch.setattr(corpora, "SENT_HITS", 14)
    many, text = found()
    assert many == few
    # Postings and clauses each meet the rare terms by key, and hits their documents.
    assert plans["best"].count("SortMergeJoin") == 2 and text.count("SortMergeJoin") == 1


def test_a_hot_sender_is_split(spark):
    """One sender, and the missing sender, hold most rows; the join still spreads them."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, 7).alias("sender_id"),
            F.sha2(F.col("id").cast("string"), 256).alias("text"),
        )
        people = spark.createDataFrame([(7, "user", None, "Hot", None, None)], ENTITY)
        frame = enrich.with_sender_name(rows, people)
        text = final(frame.groupBy("sender_name").agg(F.count("*").alias("n"), F.max("text")))
        assert "skew=true" in text
        counts = {r.sender_name: r.n for r in frame.groupBy("sender_name").agg(F.count("*").alias("n")).collect()}
        assert counts == {"Hot": 20000, None: 40000}
    finally:
        for key in conf:
            spark.conf.unset(key)


def test_a_hot_chat_is_split(spark):
    """One chat holds most messages; the join with the chats still spreads them."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    accounts = spark.createDataFrame([(0, "north", 1, ["900", "901"])], SESSION)
    people = spark.createDataFrame([(1, "user", None, "Own", None, None), (900, "group", None, None, None, "Hot"), (901, "group", None, None, None, "Quiet")], ENTITY)
    raw = spark.range(0, 40000, 1, 8).select(
        F.lit("north").alias("session_name"),
        F.when(F.col("id") % 3 < 2, 900).otherwise(901 + F.col("id") % 600).cast("bigint").alias("chat_id"),
        F.col("id").alias("message_id"),
        F.lit("message").alias("kind"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
        (10_000 + F.col("id")).alias("from_user_id"),
        F.lit(None).cast("bigint").alias("from_channel_id"),
        F.lit(None).cast("bigint").alias("from_chat_id"),
        F.col("id").alias("date"),
    )
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        frame = enrich.enrich(raw, people, accounts, explode_chats(accounts)).groupBy("chat_title").agg(F.count("*").alias("n"), F.max("text"))
        text = final(frame)
        counts = {r.chat_title: r.n for r in frame.collect()}
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert re.search(r"SortMergeJoin\(skew=true\) \[chat_id", text)
    assert counts["Hot"] == sum(i % 3 < 2 for i in range(40000)) and set(counts) <= {"Hot", "Quiet"}


def test_long_literal_lists_skip_row_groups(spark):
    """Rows read, not the plan's text: a list of values beyond ten is pushed as a mere range."""
    path = scratch_dir(spark, "literals")
    keys = spark.range(0, 300_000, 1, 1).select(F.format_string("k%07d", "id").alias("id"))
    keys.write.option("parquet.block.size", 200_000).option("parquet.page.row.count.limit", 2000).parquet(path)
    wanted = [f"k{i:07d}" for i in range(0, 300_000, 6_000)]

    def rows_read(condition):
        frame = spark.read.parquet(path).filter(condition)
        assert frame.count() == len(wanted)
        frame.collect()
        scan = frame._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return scan.metrics().apply("numOutputRows").value()

    assert rows_read(any_of("id", wanted)) < 0.6 * rows_read(F.col("id").isin(wanted))


def test_a_chat_scope_reaches_the_postings(spark, new_index, documents):
    index = new_index(buckets=2)
    index.append(documents(dict(message_id=1), dict(message_id=2, chat_id=5)))
    searches = spark.createDataFrame([("a", "harvest", 5)], "search_id string, query string, scope_chat_id bigint")
    frame = ranked_searches(IndexCorpus(index), searches, 5, bounded=True)
    assert [r.chat_id for r in frame.collect()] == [5]
    found, _ = IndexCorpus(index).lookup(matching.clauses(searches), True)
    assert "EqualTo(chat_id,5)" in details(found)


def test_postings_of_few_terms_are_not_shuffled(spark, monkeypatch, new_index, documents):
    from msgsearch.sources import corpus as module

    index = new_index()
    index.append(documents(*[dict(message_id=n, text=f"common rare{n}") for n in range(1, 41)]))
    terms = spark.createDataFrame([("text", "common"), ("text", "rare7"), ("text", "none")], "field string, term string")
    plans = []
    keep = module.stored
    monkeypatch.setattr(module, "stored", lambda rows, label: (plans.append((label, rows._jdf.queryExecution().toString())), keep(rows, label))[1])

    def placed():
        plans.clear()
        found, frequencies = IndexCorpus(index.at()).placed(terms)
        return sorted(map(tuple, found.collect())), sorted(map(tuple, frequencies.collect()))

    few = placed()
    assert "xxhash64" not in dict(plans)["found"] and len(few[0]) == 41
    monkeypatch.setattr(module, "MOST_FREQUENT", 1)
    assert placed() == few


def test_a_scan_passes_over_the_texts_once(spark, many):
    """Lengths come from the pass that finds the wanted terms."""
    searches = spark.createDataFrame([("a", "common word2"), ("b", "天气")], "search_id string, query string")
    found, weights = ScanCorpus(many).lookup(matching.clauses(searches), True)
    assert "regexp_extract_all" not in plan(found) + plan(weights)
    slow_found, slow = ScanCorpus(many).lookup(matching.clauses(searches), False)
    assert sorted(weights.collect()) == sorted(slow.collect()) != []
    columns = sorted(found.columns)
    assert sorted(found.select(columns).collect(), key=repr) == sorted(slow_found.select(columns).collect(), key=repr)
