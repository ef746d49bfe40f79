import random

import pytest
from pyspark.sql import functions as F

from msgsearch.operators.context import context, neighbours
from msgsearch.operators.sequence import message_sequence, slab_directory
from msgsearch.operators.topk import top_k
from msgsearch.sources.corpus import IndexCorpus, ScanCorpus

HIT = "session_name string, chat_id bigint, message_id bigint, before int, after int"


@pytest.fixture(params=["scan", "index"])
def corpus(request, new_index):
    def build(frame):
        if request.param == "scan":
            return ScanCorpus(frame)
        index = new_index(buckets=4)
        index.append(frame)
        return IndexCorpus(index)

    return build


def around(spark, corpus, hit, before, after, bounded=True):
    hits = spark.createDataFrame([(*hit, before, after)], HIT)
    rows = context(corpus, hits, bounded).collect()
    return sorted((r.session_name, r.chat_id, r.message_id) for r in rows)


def numbers(documents, *ids, **more):
    return documents(*[dict(message_id=i, text=f"msg {i}", **more) for i in ids])


@pytest.mark.parametrize("bounded", [True, False])
def test_order_and_gaps(spark, corpus, documents, bounded):
    source = corpus(numbers(documents, 1, 2, 5, 6, 7, 8))

    def near(before, after):
        return [i for _, _, i in around(spark, source, ("north", 8801, 5), before, after, bounded)]

    assert near(2, 2) == [1, 2, 5, 6, 7]
    assert near(0, 0) == [5]
    assert near(0, 9) == [5, 6, 7, 8]
    assert near(1, 0) == [2, 5]


def test_isolation(spark, corpus, documents):
    frame = (
        numbers(documents, 1, 2, 3)
        .unionByName(numbers(documents, 2, chat_id=200))
        .unionByName(numbers(documents, 2, 3, session_name="south"))
    )
    rows = around(spark, corpus(frame), ("north", 8801, 2), 1, 1)
    assert rows == [("north", 8801, 1), ("north", 8801, 2), ("north", 8801, 3)]


def test_negative_ids_only_after_the_hit(spark, corpus, documents):
    source = corpus(numbers(documents, -3, -1, 1, 2))
    assert [i for *_, i in around(spark, source, ("north", 8801, 1), 5, 5)] == [1, 2]
    assert [i for *_, i in around(spark, source, ("north", 8801, -3), 5, 2)] == [-3, -1, 1]


def test_budget(spark, documents):
    source = ScanCorpus(numbers(documents, *range(1, 61)))
    assert [i for *_, i in around(spark, source, ("north", 8801, 30), 15, 15)] == list(range(20, 41))
    assert [i for *_, i in around(spark, source, ("north", 8801, 30), 4, 30)] == list(range(26, 47))


@pytest.mark.parametrize("slab_bits, group_bits", [(2, 1), (1, 3), (4, 2), (16, 22)])
def test_sequence_against_brute_force(spark, slab_bits, group_bits):
    """Small slabs, so that chats cross slabs and groups of slabs."""
    random.seed(7)
    rows = [
        (s, c, i)
        for s in ("a", "b")
        for c in (1, 2)
        for i in random.sample(range(-50, 5000), 150 if (s, c) == ("a", 1) else 7)
    ]
    keys = spark.createDataFrame(rows, "session_name string, chat_id bigint, message_id bigint")
    got = {tuple(r)[:3]: r.seq for r in message_sequence(keys, slab_bits, group_bits).collect()}
    want = {}
    for chat in {r[:2] for r in rows}:
        for seq, row in enumerate(sorted(r for r in rows if r[:2] == chat), 1):
            want[row] = seq
    assert got == want


@pytest.mark.parametrize("k", [3, 1500])
def test_top_k_against_brute_force(spark, k):
    """One key holds most rows; 1500 takes the salted way."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 7 == 0, "small").otherwise("hot").alias("key"),
        F.col("id").cast("string").alias("id"),
        (F.hash("id") % 50).alias("score"),
    )
    order = [F.desc("score"), F.asc("id")]
    got = {(r.key, r.position): r.id for r in top_k(rows, ["key"], order, k, "id").collect()}
    data, want = rows.collect(), {}
    for key in ("small", "hot"):
        ranked = sorted((r for r in data if r.key == key), key=lambda r: (-r.score, r.id))[:k]
        want.update({(key, n): r.id for n, r in enumerate(ranked, 1)})
    assert got == want


@pytest.mark.parametrize("partitions", ["1", "2", "9"])
def test_top_k_of_a_large_k_with_any_number_of_shares(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.range(6000).selectExpr("'one' AS key", "id", "id % 7 AS score")
        got = top_k(rows, ["key"], [F.desc("score"), F.asc("id")], 2000, "id")
        assert got.columns == ["key", "id", "score", "position"]
        found = [r.id for r in got.orderBy("position").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == sorted(range(6000), key=lambda i: (-(i % 7), i))[:2000]


@pytest.mark.parametrize("bounded", [True, False])
def test_neighbours_across_slabs_against_brute_force(spark, bounded):
    """Slabs of four ids, many of them almost empty, so that context spans up to 20 slabs."""
    random.seed(3)
    rows = [("a", 1, i) for i in random.sample(range(-20, 600), 90)]
    rows += [("a", 2, i) for i in range(50)] + [("b", 1, 5)]
    keys = spark.createDataFrame(rows, "session_name string, chat_id bigint, message_id bigint")
    sizes = [(0, 0), (3, 4), (20, 0), (0, 20), (10, 10)]
    asked = [(*row, *sizes[n % len(sizes)]) for n, row in enumerate(rows)]
    hits = spark.createDataFrame(asked, HIT)
    near = neighbours(hits, keys, slab_directory(keys, 2), bounded, 2, 3)
    got = sorted((r.id.rsplit(":", 1)[0], r.hit_message_id, int(r.id.rsplit(":", 1)[1])) for r in near.collect())
    want = []
    for s, c, hit, before, after in asked:
        chat = sorted(i for s2, c2, i in rows if (s2, c2) == (s, c))
        lower = [i for i in chat if 0 <= i < hit][-before:] if before else []
        upper = [i for i in chat if i > hit][:after]
        want += [(f"{s}:{c}", hit, i) for i in [*lower, hit, *upper]]
    assert got == sorted(want)
