import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from msgsearch.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def by_hand(rows):
    rows = [tuple(x or "" for x in r) for r in rows]  # lang, source, text
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        own = Counter(TERM.findall(lowered(text)))
        counts[lang, source] += own
        docs[lang].update(set(own))
    out = []
    for lang in {r[0] for r in rows}:
        kept = {t for t, n in docs[lang].items() if n >= 3}
        sources = sorted({r[1] for r in rows if r[0] == lang})
        every = Counter()
        for s in sources:
            every += Counter({t: n for t, n in counts[lang, s].items() if t in kept})

        def probs(own):
            total = sum(n for t, n in own.items() if t in kept)
            return {t: 1 + 1_000_000_000 * (own[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: probs(counts[lang, s]) for s in sources}
        q = probs(every)
        for s in sources:
            pairs = [(x, sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept)) for x in sources if x != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


def audited(frame):
    return sorted(map(tuple, dv.audit(frame).collect()))


def frame_of(spark, rows, extra=()):
    return spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", *extra)


def some_rows(many, seed, words=120, sources=7):
    rng = random.Random(seed)
    spelled = [f"{rng.choice(['w', 'Ü', 'é', 'Z', '語'])}{''.join(rng.choice('abcAB') for _ in range(rng.randrange(1, 4)))}" for _ in range(words)]
    glue = [" ", ",", "1", "\n", "_", "-", "\x00", "\x7f"]
    rows = []
    for _ in range(many):
        picks = [spelled[min(int(rng.expovariate(0.05)), words - 1)] for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "de"]), f"s{int(rng.expovariate(0.5)) % sources}", "".join(p + rng.choice(glue) for p in picks)))
    return rows


def test_by_hand(spark):
    for seed in (1, 2):
        rows = some_rows(150, seed)
        assert audited(frame_of(spark, rows)) == by_hand(rows)


def test_nulls_repeats_groups_without_terms_and_clashing_columns(spark):
    rows = some_rows(60, 3) + [(None, None, "alone"), (None, "x", None), ("fr", "a", "1 2 3"), ("fr", "b", ""), ("fr", "c", "Rare"), ("it", "only", "ciao")]
    rows += [("pt", "p", "igual igual"), ("pt", "q", "igual outro")] * 3 + [("en", "", "empty source"), ("en", None, "no source")]
    extra = ["1 AS term", "2 AS n", "3 AS stretch", "4 AS id", "5 AS first", "6 AS p", "7 AS value"]
    got = audited(frame_of(spark, rows, extra))
    assert got == by_hand(rows)
    assert ("fr", "a", "pair", "b", 0, 1) in got and not any(r[0] == "it" for r in got)


def test_more_terms_than_shown_and_ties(spark):
    text = " ".join("x" + "".join("abcdefgh"[int(d)] for d in f"{i:04o}") for i in range(700))
    rows = [("en", "s", text)] * 3 + [("en", "t", "other words here")] * 3
    got = audited(frame_of(spark, rows))
    assert got == by_hand(rows)
    assert sum(r[1] == "s" and r[2] == "term" for r in got) == 200


def test_very_long_text_in_one_group(spark):
    rows = some_rows(30, 5) + [("en", "s0", "Long wörd " * 400_000)] * 3
    assert audited(frame_of(spark, rows)) == by_hand(rows)


def test_split_in_many_slices(spark, monkeypatch):
    rows = some_rows(80, 7)
    monkeypatch.setattr(dv, "SLICE", 50)
    assert audited(frame_of(spark, rows).repartition(5)) == by_hand(rows)


def test_counts_beyond_long_products(spark):
    frame = spark.createDataFrame([(10**15, 10**16, 7), (3, 10, 5)], "c bigint, n bigint, v bigint")
    got = [r[0] for r in frame.select(dv.probability(*(dv.F.col(x) for x in "cnv"))).collect()]
    assert got == [1 + 10**9 * (10**15 + 1) // (10**16 + 7), 1 + 10**9 * 4 // 15]


def test_cells_against_sets():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 4, (5, 150))
    p = {(s, c): int(rng.integers(1, 1000)) for s in range(5) for c in range(4)}
    rows = []
    for s in range(5):
        for c in (1, 2, 3):
            at = np.flatnonzero(counts[s] == c)
            rows += [(w, s, p[s, c], p[s, 0], sum(1 << int(x % 64) for x in at if x // 64 == w)) for w in range(3)]
    rows = sorted(r for r in rows if r[4])
    word, source, value, zero = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    first, second, got = dv.joint_cells(value, zero, source, word, np.array([r[4] for r in rows], np.uint64))

    def f(a, b):
        return (a - b) ** 2 // b

    for s, t, v in zip(first.tolist(), second.tolist(), got.tolist()):
        want = 0
        for a, b in zip(counts[s].tolist(), counts[t].tolist()):
            if a and b:
                want += f(p[s, a], p[t, b]) - f(p[s, a], p[t, 0]) - f(p[s, 0], p[t, b]) + f(p[s, 0], p[t, 0])
        assert v == want


def test_terms_of_texts():
    texts = pa.array(["", None, "Ab1cD é_É", " x", "y", "\x00z\x7f", "日本 go"])
    coded, owner = dv.terms_of(texts)
    got = [(int(o), t.decode()) for o, t in zip(owner, coded.to_pylist())]
    assert got == [(i, lowered(t)) for i, x in enumerate(texts.to_pylist()) for t in TERM.findall(x or "")]


def test_empty_table(spark):
    none = dv.audit(frame_of(spark, [("a", "b", "c")]).where("false"))
    assert none.count() == 0 and none.columns == ["lang", "source", "part", "item", "value", "rank"]
