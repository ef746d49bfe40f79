import os
import random
import subprocess
import sys

import corpus_pipeline

ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))

random.seed(4)
WORDS = {k: [f"{k}{''.join(random.choice('abcdefgh') for _ in range(5))}" for _ in range(300)] for k in ("en", "de")}


def text_of(lang, many):
    return " ".join(random.choice(WORDS[lang]) for _ in range(many))


def corpus():
    rows = [(i, text_of("en" if i % 3 else "de", 60), "en" if i % 3 else "de", f"s{i % 4}") for i in range(120)]
    passage = text_of("en", 55)
    rows[10] = (10, f"{rows[10][1]} {passage}", "en", "s0")
    rows[11] = (11, f"{passage} {rows[11][1]}", "en", "s1")
    copy = rows[20][1].split()
    copy[30] = "changed"
    rows += [(200, rows[20][1], "en", "s0"), (201, " ".join(copy), "en", "s1"), (202, None, "en", "s0"), (203, "1 2 3", "en", "s0")]
    rows += [(204, "too short", "en", "s0"), (205, text_of("en", 8) + " " + "same eight words said again and again here " * 20, "en", "s2")]
    rows += [(300, rows[30][1], "de", "s2"), (300, rows[30][1], "de", "s2"), (None, text_of("de", 50), None, None)]
    return rows


def test_stages_keep_clean_documents_and_catch_the_rest(spark, texts):
    rows = corpus()
    docs = texts(*rows, extra="1 AS score").selectExpr("*", "2 AS kept", "3 AS sequence_id")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == corpus_pipeline.COLUMNS, name
        kept.append({r.doc_id: r for r in docs.collect()})
        kept[-1]["rows"] = docs.count()
    language, quality, near, passages = kept
    assert set(range(120)) <= set(language) and {202, 203}.isdisjoint(language) and None in language
    assert set(range(120)) <= set(quality) and {204, 205}.isdisjoint(quality)
    assert set(near) - {"rows"} == set(range(120)) | {None} and near["rows"] == 121
    texts_of = {r[0]: r[1] for r in rows}
    for i in range(120):
        expected = " ".join(texts_of[i].split()[:60]) if i == 10 else " ".join(texts_of[i].split()[55:]) if i == 11 else texts_of[i]
        assert passages[i].text == expected and passages[i].n_chars == len(expected), i
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in placed} == set(passages) - {"rows"}


def test_empty_table(spark, texts):
    docs = texts((1, "a", "en", "s")).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_run_over_a_folder(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {r.length for r in rows} <= set(range(1, 1025))


def test_the_rest_does_not_need_this_folder():
    code = (
        "import sys; sys.modules['msgsearch.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; names = e.queries(); assert names and not any(n.startswith('op') or n == 'pipeline' for n in names)"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
