import itertools

import numpy as np
import pytest

from msgsearch.llm import language_spans as ls

EN = "the quick brown fox jumps over the lazy dog and then runs with the others into the wood"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann mit den anderen in den wald"
RU = "быстрая лиса прыгает через ленивую собаку и потом бежит с другими в лес"


@pytest.fixture
def model(texts):
    rows = [(i, EN, "en") for i in range(40)] + [(i, DE, "de") for i in range(40, 70)] + [(i, RU, "ru") for i in range(70, 90)]
    rows += [(100, None, "xx"), (101, "no language", None)]
    return ls.fit(texts(*rows).select("text", "lang", "doc_id"))


def test_labels_are_the_best_path(monkeypatch):
    monkeypatch.setattr(ls, "SWITCH", 4.0)
    rng = np.random.default_rng(0)
    for _ in range(60):
        bounds = np.concatenate(([0], np.cumsum(rng.integers(0, 8, 5))))
        scores = -rng.integers(0, 9, (bounds[-1], 3)).astype(float)
        found = ls.labels(scores, bounds)
        for low, high in zip(bounds[:-1], bounds[1:]):
            own = scores[low:high]

            def worth(path):
                return sum(own[i, s] for i, s in enumerate(path)) - 4 * sum(a != b for a, b in zip(path, path[1:]))

            if high > low:
                best = max(map(worth, itertools.product(range(3), repeat=high - low)))
                assert worth(found[low:high].tolist()) == pytest.approx(best)


def test_more_languages_than_a_byte_counts():
    scores = np.full((3, 300), -50.0)
    scores[:, 299] = 0
    assert ls.labels(scores, np.array([0, 2, 3])).tolist() == [299, 299, 299]


def test_spans_scripts_and_odd_texts(texts, model):
    assert model.languages == ["de", "en", "ru"]
    frame = texts((1, f"{EN} {DE}"), (2, RU.upper()), (3, None), (4, ""), (5, "12 — $"), (6, "日本語"), (7, EN * 3000), (7, EN), (None, DE), extra="'x' AS lang_pred")
    rows = ls.identify(frame, model, with_spans=True).collect()
    assert len(rows) == 9
    found = {r.doc_id: r for r in rows if r.doc_id != 7}
    one = found[1]
    assert [s.lang for s in one.spans] == ["en", "de"] and one.lang_pred in ("en", "de") and 0.4 < one.score < 0.6
    raw = f"{EN} {DE}".encode()
    assert raw[one.spans[0].begin : one.spans[0].end].decode() == EN
    assert raw[one.spans[1].begin : one.spans[1].end].decode() == DE
    assert (found[2].lang_pred, found[2].score) == ("ru", 1.0)
    assert all((found[k].lang_pred, found[k].score) == ("und", 0.0) for k in (3, 4, 5))
    assert (found[6].lang_pred, found[6].score) == ("en", 0.0)
    assert {r.lang_pred for r in rows if r.doc_id == 7} == {"en"} and found[None].lang_pred == "de"


def test_nothing_learned_and_empty(texts, model):
    nothing = ls.fit(texts((1, "a", None)).select("text", "lang", "doc_id"))
    assert ls.identify(texts((1, "abc")), nothing).first().lang_pred == "und"
    assert ls.identify(texts((1, "abc")).where("false"), model).count() == 0


def test_held_out_accuracy(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in frame.select("doc_id", "lang").collect()}
    rows = [r for r in ls.predicted_languages(frame).collect() if r.held_out]
    assert len(rows) > 100 and np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.98
