import random
from collections import Counter

import pytest

from msgsearch.llm import jaccard_groups as jg


def brute(docs, shingle, percent):
    sets = {}
    for i, text in docs:
        words = (text or "").encode().lower().split()
        runs = [tuple(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or ([tuple(words)] if words else [])
        sets[i] = frozenset(runs)
    holders, parent = {}, {i: i for i in sets}
    for i, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(i)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in sets.items():
        common = Counter(j for s in own for j in holders[s] if j < i)
        for j, c in common.items():
            if 100 * c >= percent * (len(own) + len(sets[j]) - c):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(own), top(i)) for i, own in sets.items()}


def corpus():
    random.seed(2)
    base = [random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(120)]
    docs = [(0, None), (1, ""), (2, "a b"), (3, "A b"), (4, "a b c"), (5, "É b"), (6, "é b")]
    for i in range(10, 200):
        words = list(base)
        for _ in range(random.choice([0, 1, 1, 2, 3, 5])):
            words[random.randrange(120)] = random.choice("xyz") + str(random.randrange(3))
        docs.append((i, " ".join(words)))
    docs += [(i, " ".join(random.choice("ab") for _ in range(random.randrange(3, 9)))) for i in range(200, 300)]
    docs += [(i, " ".join(f"{i}w{k}" for k in range(3000)) + " end" * (i % 3)) for i in (301, 302)]
    return docs


@pytest.mark.parametrize("shingle, percent", [(4, 85), (1, 50)])
def test_equals_brute_force(texts, shingle, percent):
    docs = corpus()
    rows = jg.linked_documents(texts(*docs), shingle, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, shingle, percent)
    assert len(rows) == len(docs)


def test_repeats_nulls_and_one_of_each(texts):
    text = " ".join(f"w{i}" for i in range(60))
    frame = texts((7, text), (7, text), (None, text), (3, text + " more"), (9, "other words here and there now"), (4, None), (4, None), extra="1 AS n").selectExpr("*", "2 AS cls")
    rows = jg.linked_documents(frame).collect()
    assert len(rows) == 7
    assert {r.component_id for r in rows if r.n_shingles > 10} == {3}
    kept = jg.one_of_each(frame).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept) == [-1, 4, 4, 9]
    assert set(kept[0].asDict()) == set(frame.columns)
    assert jg.linked_documents(frame.where("false")).count() == 0


@pytest.mark.parametrize("shingle, percent", [(4, 85), (1, 50)])
def test_large_buckets_are_cut_and_lose_nothing(texts, monkeypatch, shingle, percent):
    monkeypatch.setattr(jg, "BLOCK", 16, raising=False)
    monkeypatch.setattr(jg, "SEEDS", 2, raising=False)
    docs = corpus()
    frame, largest = texts(*docs), []
    plain = type(frame).mapInArrow

    def watched(self, function, schema, *more):
        if function.__qualname__.startswith("_bucket_pairs"):
            largest.append(self.groupBy("bucket").count().agg({"count": "max"}).first()[0] or 0)
        return plain(self, function, schema, *more)

    monkeypatch.setattr(type(frame), "mapInArrow", watched)
    rows = jg.linked_documents(frame, shingle, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, shingle, percent)
    assert len(largest) == 4 and max(largest) < 64
