import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from msgsearch.llm import class_model as cm
from msgsearch.llm.common import Words


def test_moves_maximise_the_likelihood():
    rng = np.random.default_rng(1)
    many, size = cm.CLASSES + cm.SHAPES + 1, 120
    classes = np.concatenate((np.arange(size - 17) % cm.CLASSES, cm.CLASSES + np.arange(17)))
    pairs = rng.poisson(1.0, (size, size))

    def counted(of):
        out = np.zeros((many, many), np.int64)
        np.add.at(out, (np.repeat(of, size), np.tile(of, size)), pairs.ravel())
        return out

    for word in (0, 5, 77):
        own, twice = classes[word], int(pairs[word, word])
        after = np.bincount(classes, pairs[word], many).astype(int)
        before = np.bincount(classes, pairs[:, word], many).astype(int)
        after[own] -= twice
        before[own] -= twice
        found = cm.best_class(counted(classes), own, after, before, twice)
        tried = []
        for k in range(cm.CLASSES):
            other = classes.copy()
            other[word] = k
            tried.append(cm.likelihood(counted(other)))
        assert tried[found] == pytest.approx(max(tried))


def corpus():
    rng = np.random.default_rng(0)
    nouns, verbs = [f"noun{i}" for i in range(30)], [f"verb{i}" for i in range(30)]
    rows = []
    for i in range(160):
        words = [str(rng.choice(nouns if k % 2 else verbs)) for k in range(60)]
        rows.append((i, " ".join(words) + f" rare{i}é Upper{i % 3} $%{i}"))
    return rows + [(500, None), (501, ""), (502, "A a"), (502, "A a"), (None, "verb1 noun1"), (503, "z" * 50_000)]


@pytest.mark.parametrize("held", [1 << 20, 10])
def test_scores(texts, monkeypatch, held):
    monkeypatch.setattr(cm, "HELD", held)
    monkeypatch.setattr(cm, "CORE", 64)
    rows = corpus()
    found = cm.scored_documents(texts(*rows, extra="1 AS score")).collect()
    assert len(found) == len(rows)
    counts, docs = Counter(), 0
    for i, text in rows:
        if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2:
            counts.update((text or "").encode().lower().split())
            docs += 1
    total, types = sum(counts.values()) + docs, len(counts) + 1
    texts_of = dict(rows)
    for r in found:
        words = (texts_of[r.doc_id] or "").encode().lower().split()
        base = sum(math.log10((c + 1) / (total + types + 1)) for c in [docs, *(counts[w] for w in words)])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, 1 + sum(counts[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(base) and r.score <= 0
    out = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def shape_of(word):
    ascii_ = [chr(b) for b in word if b < 0x80]
    sign = any(not c.isalnum() and c not in ".,;:!?" for c in ascii_)
    return any(b >= 0x80 for b in word) + 2 * any(c.isdigit() for c in ascii_) + 4 * sign + 8 * (word[-1:] in b".,;:!?")


@pytest.mark.parametrize("core, held", [(16, 1 << 20), (64, 70), (4096, 1 << 20)])
def test_score_by_definition(texts, monkeypatch, core, held):
    """Everything but which class a word is in, from the texts themselves."""
    monkeypatch.setattr(cm, "CORE", core)
    monkeypatch.setattr(cm, "HELD", held)
    rows = corpus()
    model = cm.fit(texts(*rows).select("text"))
    split = [(t or "").encode().lower().split() for _, t in rows]
    counts = Counter(w for words in split for w in words)
    named = {int(Words(pa.array([w.decode()])).hashes[0]): w for w in counts}
    place = {named[int(h)]: int(i) for h, i in zip(model.tables.hashes, model.tables.ids)}
    least = min(counts[w] for w in place)
    assert set(place) == {w for w in counts if counts[w] >= least}
    assert held < 100 or max((n for w, n in counts.items() if w not in place), default=0) < cm.LEAST_CLASSED

    def cls(word):
        return int(model.classes[place[word]]) if word in place else cm.CLASSES + shape_of(word)

    end = cm.CLASSES + cm.SHAPES
    pairs = np.full((end + 1, end + 1), cm.TRANSITION)
    for words in split:
        chain = [end, *map(cls, words), end]
        for a, b in zip(chain, chain[1:]):
            pairs[a, b] += 1
    sizes = Counter()
    for w in place:
        sizes[cls(w)] += counts[w]
    rest = {w: n for w, n in counts.items() if w not in place}

    def emitted(word):
        if word in place:
            return counts[word] / sizes[cls(word)]
        own = [n for w, n in rest.items() if shape_of(w) == shape_of(word)]
        once, twice = own.count(1), own.count(2)
        total = sum(own) + once + 1
        unseen = max(once * (once - 1) / (2 * (twice + 1)), once + 1)
        return rest[word] / total if word in rest else (once + 1) / unseen / total

    asked = [*rows[:30], *rows[160:], (900, "never seen words Übel 77x noun1 verb2, rare3é")]
    for r in cm.score(texts(*asked).selectExpr("doc_id", "text"), model).collect():
        words = (dict(asked)[r.doc_id] or "").encode().lower().split()
        chain = [end, *map(cls, words), end]
        want = sum(math.log10(pairs[a, b] / pairs[a].sum()) for a, b in zip(chain, chain[1:])) + sum(math.log10(emitted(w)) for w in words)
        assert r.score == pytest.approx(want), r.doc_id
    assert (model.shape_unknown <= 1).all()


def test_unseen_texts_are_harder(spark):
    found = cm.scored_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()

    def perplexity(held_out):
        own = [r for r in found if r.held_out == held_out]
        return 10 ** (-sum(r.score for r in own) / sum(r.n_tokens for r in own))

    assert perplexity(True) > perplexity(False)


def test_words_join_the_class_of_their_neighbours(texts, monkeypatch):
    """Words outside the core stand where nouns or verbs stand, and get a class of these."""
    monkeypatch.setattr(cm, "CORE", 70)
    rng = np.random.default_rng(5)
    nouns, verbs = [f"noun{i}" for i in range(33)], [f"verb{i}" for i in range(33)]
    rows = [(i, " ".join(str(rng.choice(nouns if k % 2 else verbs)) for k in range(60))) for i in range(200)]
    rows += [(300 + i, f"verb1 newnoun{i % 3} verb2 noun3 newverb{i % 3} noun1") for i in range(30)]
    model = cm.fit(texts(*rows).select("text"))
    tables = model.tables

    def cls(word):
        at = np.searchsorted(tables.hashes, Words(pa.array([word])).hashes[0])
        return int(model.classes[tables.ids[at]])

    for kind, own, other in (("newnoun", nouns, verbs), ("newverb", verbs, nouns)):
        found = {cls(f"{kind}{i}") for i in range(3)}
        assert found <= set(map(cls, own)) and found.isdisjoint(map(cls, other))


def test_probabilities_sum_to_one(texts, monkeypatch):
    monkeypatch.setattr(cm, "CORE", 64)
    model = cm.fit(texts(*corpus()).select("text"))
    assert np.allclose((10.0**model.transitions).sum(1), 1)
    members = np.bincount(model.classes[: model.tables.size], 10.0 ** model.members[: model.tables.size])
    assert np.allclose(members[members > 0], 1)


def test_nothing_to_learn_from(texts):
    model = cm.fit(texts((1, "a")).where("false").select("text"))
    (row,) = cm.score(texts((1, "a b")), model).collect()
    assert row.n_known == 0 and row.train_tokens == 0 and math.isfinite(row.score)
    assert cm.score(texts((1, "a")).where("false"), model).count() == 0


def test_a_tally_holds_little_beside_its_sums(monkeypatch):
    monkeypatch.setattr(cm, "TALLIED", 100)
    tally = cm.Tally()
    for _ in range(50):
        tally.add(np.arange(60).repeat(2))
        assert sum(map(len, tally.keys)) <= 60 + 100 + 60
    found, sums = tally.total()
    assert found.tolist() == list(range(60)) and set(sums.tolist()) == {100} and tally.held == 60
