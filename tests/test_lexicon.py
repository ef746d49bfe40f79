"""Dictionary words in runs of ideographs: the rule, both ways of finding words, and searches."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from msgsearch.operators import lexicon as module
from msgsearch.operators.lexicon import Lexicon
from msgsearch.plans.search import search
from msgsearch.sources.corpus import IndexCorpus, ScanCorpus

WORDS = ["研究", "研究生", "生命", "起源", "研究生院", "生院"]


def dictionary(spark, words=WORDS):
    return Lexicon.of(spark.createDataFrame([(w,) for w in words], "word string"))


@pytest.fixture(params=["sent", "joined"])
def way(request, monkeypatch):
    if request.param == "joined":
        monkeypatch.setattr(module, "MAX_WORDS", 1)
    return request.param


def test_longest_words_and_the_words_inside(spark, way):
    lexicon = dictionary(spark, [*WORDS, "研究", "生", "ab", "", None])
    assert (lexicon.held is None) == (way == "joined")
    texts = [
        "研究生命起源",  # the longest word from the left, then what is left over
        "AB研究生院cd 生命",
        "😀研究",  # places count code points
        "研 究",  # words do not cross blanks
        "plain words",
        "",
        None,
        "研究",
        "研究",  # repeated rows
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").withColumn("words", F.lit("clash"))
    found = {r.n: r.t_terms for r in lexicon.with_index_terms(rows, "t").collect()}
    assert found == {
        0: ["研究生", "命", "起源", "研究"],
        1: ["ab", "cd", "研究生院", "生命", "研究生", "研究", "生院"],
        2: ["研究"],
        3: ["研", "究"],
        4: ["plain", "words"],
        5: [],
        6: [],
        7: ["研究"],
        8: ["研究"],
    }
    asked = lexicon.with_query_terms(rows.filter("t IS NOT NULL"), "t")
    assert {r.n: r.t_terms for r in asked.filter("n IN (0, 1)").collect()} == {
        0: ["研究生", "命", "起源"],
        1: ["ab", "cd", "研究生院", "生命"],
    }


def brute(text, words):
    """All terms, place by place."""
    out, at = [], 0
    while at < len(text):
        if not "一" <= text[at] <= "鿿":
            at += 1
            continue
        taken = max((w for w in words if text.startswith(w, at)), key=len, default=text[at])
        out.append(taken)
        out += [w for i in range(len(taken)) for w in words if w != taken and taken.startswith(w, i)]
        at += len(taken)
    return sorted(out)


def test_as_brute_force(spark, way):
    draw = random.Random(5)
    words = sorted({"".join(draw.choices("甲乙丙", k=draw.randint(2, 5))) for _ in range(12)})
    texts = ["".join(draw.choices("甲乙丙 😀", k=draw.randint(0, 60))).replace(" ", "-") for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = dictionary(spark, words).with_index_terms(rows, "t").collect()
    assert {r.t: sorted(r.t_terms) for r in found} == {t: brute(t, words) for t in texts}
    assert len(found) == len(texts)


def test_a_very_long_run(spark, way):
    n = 60_000
    rows = spark.range(1).select(F.repeat(F.lit("哈"), n).alias("t"))
    row = dictionary(spark, ["哈哈", "哈哈哈"]).with_index_terms(rows, "t").select(F.size("t_terms")).first()
    assert row[0] == n // 3 * 3  # each word of three has two of two inside


def test_empty_dictionary_and_tables(spark):
    rows = spark.createDataFrame([("天气ok",)], "t string")
    none = dictionary(spark, [])
    assert none.with_index_terms(rows, "t").first().t_terms == ["ok", "天", "气"]
    assert dictionary(spark).with_index_terms(rows.limit(0), "t").count() == 0


def test_search_finds_words_and_no_false_pairs(spark, documents, new_index, way):
    many = documents(
        dict(message_id=1, text="研究生命起源"),  # has 生命 as neighbours, but not as a word
        dict(message_id=2, text="生命 的 意义"),
        dict(message_id=3, text="研究生院 open"),
        dict(message_id=4, text="x", chat_title="研究 group"),
    )
    lexicon = dictionary(spark)

    def found(corpus, query):
        return {r.message_id for r in search(corpus, query).collect()}

    assert found(ScanCorpus(many), "生命") == {1, 2}
    index = new_index()
    index.lexicon = lexicon
    index.append(many)
    for corpus in (ScanCorpus(many, lexicon), IndexCorpus(index)):
        assert found(corpus, "生命") == {2}
        assert found(corpus, "研究") == {1, 3, 4}
        assert found(corpus, "研究生院") == {3}
        assert found(corpus, "open 起源") == {1, 3}


def test_texts_are_cut_in_bounded_stretches(spark, monkeypatch):
    many = module.SLICE // 3 + 1
    texts = pa.array(["生" * many, None, "研究", "生" * many, "", "生"])
    stretches = [x.to_pylist() for (x,) in module._slices(texts)]
    assert [len(x) for x in stretches] == [1, 3, 2]
    assert sum(stretches, []) == texts.to_pylist()
    rows = spark.createDataFrame(list(enumerate(texts.to_pylist())), "n int, t string").coalesce(1)
    found = {r.n: r.t_terms for r in dictionary(spark).with_index_terms(rows, "t").collect()}
    assert found == {0: ["生"] * many, 1: [], 2: ["研究"], 3: ["生"] * many, 4: [], 5: ["生"]}
