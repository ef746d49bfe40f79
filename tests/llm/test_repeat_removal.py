import hashlib
import random
from collections import Counter

import pytest

from msgsearch.llm import repeat_removal as rr


def brute(docs, window):
    words = [(d or "").encode().split() for d in docs]
    times = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if times[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def corpus():
    random.seed(1)
    docs = [None, "", "a " * 100, " ".join(random.choice("ab") for _ in range(300)), "x " * 34, "x " * 35, "x " * 36]
    docs += [" ".join(random.choice("abc") for _ in range(80)) for _ in range(15)]
    return docs + docs[3:7] + ["pre " + docs[10] + " post", None, " ".join(f"u{i}" for i in range(9000))]


@pytest.mark.parametrize("window", [35, 5, 12])
def test_equals_brute_force(texts, window):
    docs = corpus()
    rows = rr.removal_digests(texts(*enumerate(docs)), window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == dict(enumerate(brute(docs, window)))


def test_a_full_sketch_loses_nothing(texts, monkeypatch):
    monkeypatch.setattr(rr, "power_of_two", lambda *a: 1 << 18)
    docs = [" ".join(random.choice("abcdefgh") for _ in range(400)) for _ in range(200)]
    docs += [docs[0], docs[1] + " tail"]
    rows = rr.removal_digests(texts(*enumerate(docs)), 20).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == dict(enumerate(brute(docs, 20)))


def test_texts_keep_their_form(texts):
    passage = " ".join(f"p{i}" for i in range(40))
    frame = texts((1, f"one\ttwo\n\n{passage}  three\nfour"), (2, f"{passage}"), (3, "clean  text\n stays"), (None, None), extra="'k' AS k1").selectExpr("*", "5 AS n_removed")
    rows = {r.doc_id: r for r in rr.remove_repeats(frame).collect()}
    assert rows[1].text == "one\ttwo three\nfour" and rows[1].n_removed == 40
    assert rows[2].text == "" and rows[3].text == "clean  text\n stays" and rows[None].text is None
    assert rows[3].k1 == "k" and rows[3].n_removed == 0
    assert rr.remove_repeats(frame.where("false")).count() == 0


def test_a_shared_phrase_does_not_gather_its_windows(texts, monkeypatch):
    monkeypatch.setattr(rr, "HOT_LEVEL", 5, raising=False)
    phrase = " ".join(f"notice{i}" for i in range(20))
    docs = [" ".join(f"a{i}x{k}" for k in range(30)) + f" {phrase} " + " ".join(f"b{i}x{k}" for k in range(30)) for i in range(300)]
    docs += [docs[0], docs[1] + " tail"]
    largest = []
    frame = texts(*enumerate(docs))
    plain = type(frame).mapInArrow

    def watched(self, function, schema, *more):
        if schema == rr.UNIQUE:
            sums = self.selectExpr("anchor", "length(windows) / 8 AS n").groupBy("anchor").sum("n").agg({"sum(n)": "max"})
            largest.append(sums.first()[0])
        return plain(self, function, schema, *more)

    monkeypatch.setattr(type(frame), "mapInArrow", watched)
    rows = rr.removal_digests(frame).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == dict(enumerate(brute(docs, 35)))
    assert largest and largest[0] < 50
