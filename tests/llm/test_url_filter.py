import math
import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from msgsearch.llm import url_filter as uf

DATA = "/root/testdata/sf0.001"

FIXED = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    head = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:head])
    tail = rest[head:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def rule_of(host, path):
    fits = []
    for verdict, rule in FIXED:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


class Plain:
    """The same model with dictionaries, one symbol at a time."""

    def __init__(self, texts):
        self.counts = [defaultdict(Counter) for _ in range(uf.ORDER + 1)]
        for text in texts:
            symbols = [uf.BEGIN] * uf.ORDER + list(text.encode()) + [uf.END]
            for i in range(uf.ORDER, len(symbols)):
                for k in range(uf.ORDER + 1):
                    self.counts[k][tuple(symbols[i - k : i])][symbols[i]] += 1

    def log(self, text):
        symbols = [uf.BEGIN] * uf.ORDER + list(text.encode()) + [uf.END]
        out = []
        for i in range(uf.ORDER, len(symbols)):
            chance = 1 / 255
            for k in range(uf.ORDER + 1):
                seen = self.counts[k].get(tuple(symbols[i - k : i]))
                if seen:
                    total, kinds = sum(seen.values()), len(seen)
                    chance = (seen[symbols[i]] + kinds * chance) / (total + kinds)
            out.append(math.log(chance))
        return out


def steps_of(good, bad, text):
    a, b = good.log(text), bad.log(text)
    return math.floor(sum(x - y for x, y in zip(a, b)) / len(a) * uf.STEPS + 0.5)


def by_hand(spark, rows):
    """Verdicts of (page_id, url), with Spark only asked which hosts are held out."""
    hosts = sorted({split(u)[0] for _, u in rows})
    frame = spark.createDataFrame([(h,) for h in hosts], "h string")
    held = {r.h for r in frame.where(F.pmod(F.xxhash64("h"), F.lit(uf.HOLD_OUT)) == 0).collect()}
    full = [(k, *split(u), *rule_of(*split(u))) for k, u in rows]
    known = [r for r in full if r[3] and r[1] not in held]
    good = Plain({r[1] + r[2] for r in known if r[4] == "allow"})
    bad = Plain({r[1] + r[2] for r in known if r[4] == "block"})
    cached = {}

    def steps(r):
        text = r[1] + r[2]
        if text not in cached:
            cached[text] = steps_of(good, bad, text)
        return cached[text]

    tests = [(steps(r), r[4] == "allow") for r in full if r[3] and r[1] in held]
    n_good = sum(a for _, a in tests)
    n_bad = len(tests) - n_good
    least = 0
    if n_good and n_bad:
        top = max(s for s, _ in tests) + 1
        tried = {0, top} | {s for s, _ in tests}

        def wrong(b):
            return sum(a for s, a in tests if s < b) * n_bad + sum(not a for s, a in tests if s >= b) * n_good

        least = min((wrong(b), abs(b), b) for b in tried)[2]
    return [(k, h, p, rule, v or ("allow" if steps((k, h, p, rule, v)) >= least else "block")) for k, h, p, rule, v in full]


def pages(spark, rows, extra=()):
    return spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", *extra)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_whole_table_by_hand(spark):
    table = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = [(r.page_id, r.url) for r in table.select("page_id", "url").collect()]
    got = sorted(map(tuple, uf.url_verdicts(table).collect()))
    assert got == sorted(by_hand(spark, rows))
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


ODD = [
    None,
    "",
    "no scheme at all",
    "http://",
    "http://com",
    "http://COM/x",
    "HTTP://Www.Example.COM/en/a",
    "http://www.example.com/en",
    "http://www.example.com/en/",
    "http://a.www.example.com/en/x?y#z",
    "http://notexample.com/en/",
    "http://example.com/EN/",
    "a://b.net/es/://c.com/",
    "http://x.net?/fr/",
    "http://x.net/fr/#/",
    "http://x.net/fr",
    "http://é.net/es/ü\n",
    "http://ÀB.com/ x",
    "://net/fr/",
    "http:///en/",
]


def test_hosts_paths_and_rules(spark):
    rows = list(enumerate(ODD))
    got = {r.page_id: tuple(r)[1:4] for r in uf.url_verdicts(pages(spark, rows)).collect()}
    for key, url in rows:
        assert got[key] == (*split(url), rule_of(*split(url))[0]), url
    assert got[9][2] == "www.example.com/en/" and got[5][2] == "com/" and got[4][2] is None


def corpus():
    rows = [(i, f"https://{'www.' if i % 3 else ''}{'good' if i % 2 else 'bad'}{i % 23}.example.{'com/de/' if i % 2 else 'net/es/'}{i}?q={i}") for i in range(300)]
    rows += [(1000 + i, f"http://{'good' if i % 2 else 'bad'}{i}.example.org/{'de' if i % 2 else 'es'}/{i}") for i in range(60)]
    return rows + [(2000 + i, u) for i, u in enumerate(ODD)] + [(5, "http://same.org/"), (5, "http://same.org/"), (None, "http://x.org/y")] + [(3000 + i, rows[1][1]) for i in range(200)]


def test_all_kinds_of_rows_by_hand(spark):
    rows = corpus()
    frame = pages(spark, rows, ["1 AS host", "2 AS rule", "3 AS steps", "4 AS text", "5 AS found", "6 AS key"])
    got = sorted(map(tuple, uf.url_verdicts(frame).collect()), key=str)
    assert got == sorted(by_hand(spark, rows), key=str)
    unseen = {r[0]: r[4] for r in got if r[0] is not None and 1000 <= r[0] < 1060}
    assert sum(v == ("allow" if k % 2 else "block") for k, v in unseen.items()) >= 57


def test_partitioning_does_not_matter(spark):
    frame = pages(spark, corpus())
    assert sorted(uf.url_verdicts(frame).collect(), key=str) == sorted(uf.url_verdicts(frame.repartition(9)).collect(), key=str)


def test_very_long_url(spark):
    long = "http://long.org/" + "ab/" * 400_000
    got = {r.page_id: r for r in uf.url_verdicts(pages(spark, [*corpus(), (9_999, long)])).collect()}
    assert got[9_999].path == "/" + "ab/" * 400_000 and got[9_999].verdict in ("allow", "block")


def test_chunks_change_nothing(monkeypatch):
    texts = pa.array([u for _, u in corpus()])
    keys = Counter()
    for side, text in enumerate(t for t in texts.to_pylist()[:40] if t):
        for _, window in uf.Spelled(pa.array([text])).chunks():
            for k in range(uf.ORDER + 1):
                for x in uf._grams(window, k).tolist():
                    keys[x, side % 2] += 1
    both = sorted({k for k, _ in keys})
    models = uf.Models.of(np.array(both, np.uint64).astype(np.int64), np.array([[keys[k, 0], keys[k, 1]] for k in both]))
    whole = models.scores(texts)
    monkeypatch.setattr(uf, "CHUNK", 11)
    assert models.scores(texts).tolist() == whole.tolist()


def test_nothing_decided_and_empty(spark):
    got = uf.url_verdicts(pages(spark, [(1, "http://a.org/"), (2, None)])).collect()
    assert {r.verdict for r in got} == {"allow"}
    none = uf.url_verdicts(pages(spark, [(1, "x")]).where("false"))
    assert none.count() == 0 and none.columns == ["page_id", "host", "path", "rule", "verdict"]


@pytest.mark.parametrize("rules, want", [([], None), ([("block", "a.org/")], "a.org/")])
def test_other_rules(spark, rules, want):
    assert uf.judge(pages(spark, [(1, "http://b.a.org/x")]), rules=rules).first().rule == want


def _counts(models):
    return [dict(zip(keys.tolist(), map(tuple, counts.tolist()))) for keys, counts in models.grams]


def test_counts_cover_every_decided_text(spark, monkeypatch):
    """More texts than the sample of before took; each is counted, once, whatever a task sends at a time."""
    many = 25_000
    rows = spark.range(many).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("text"), (F.col("id") % 5 > 0).alias("allowed"))
    expected = _counts(uf.fit(rows.union(rows)))
    first = sum(1 for _ in range(many))
    assert expected[1][(2 << 56) | (uf.BEGIN << 8) | ord("h")] == (first * 4 // 5, first // 5)
    monkeypatch.setattr(uf, "TALLIED", 1000)
    assert _counts(uf.fit(rows)) == expected


def test_workers_hold_the_most_frequent_contexts(spark, monkeypatch):
    rows = spark.createDataFrame([(x, x < "n") for x in ("aa", "ab", "ac", "xyz", "xyw", "q")], "text string, allowed boolean")
    whole = uf.fit(rows)
    monkeypatch.setattr(uf, "HELD", 16)
    cut = uf.fit(rows)
    held = sum(len(keys) for keys, _ in cut.grams)
    assert 0 < held <= 16 < sum(len(keys) for keys, _ in whole.grams)
    # Shorter contexts first, and each with all that follows it.
    assert _counts(cut)[0] == _counts(whole)[0]
    for (contexts, totals, kinds), all_contexts in zip(cut.contexts, whole.contexts):
        place = np.searchsorted(all_contexts[0], contexts)
        assert (all_contexts[0][place] == contexts).all() and (all_contexts[1][place] == totals).all() and (all_contexts[2][place] == kinds).all()


@pytest.mark.parametrize("held", [0, 300, 2000])
def test_contexts_that_workers_do_not_hold_count_too(spark, monkeypatch, held):
    """The same scores as with all contexts in each worker, over several cells, with repeats and nulls."""
    rows = corpus()
    frame = pages(spark, rows, ["1 AS _cell", "2 AS context"]).repartition(3)
    whole = sorted(map(tuple, uf.judge(frame).collect()), key=str)
    monkeypatch.setattr(uf, "HELD", held)
    monkeypatch.setattr(uf, "SLICE", 2000)
    found = uf.fit(spark.createDataFrame([(u, i % 2 == 0) for i, u in rows if i], "text string, allowed boolean"))
    assert found.rest is not None and sum(len(keys) for keys, _ in found.grams) <= held
    assert sorted(map(tuple, uf.judge(frame).collect()), key=str) == whole
    got = sorted(map(tuple, uf.url_verdicts(frame).collect()), key=str)
    assert got == sorted(by_hand(spark, rows), key=str)


def test_missing_contexts(monkeypatch):
    """Longer contexts of one that was never seen are not looked for."""
    keys = np.unique(np.concatenate([uf._grams(w, k) for _, w in uf.Spelled(pa.array(["abc"])).chunks() for k in range(uf.ORDER + 1)]))
    models = uf.Models.of(keys.astype(np.int64), np.ones((len(keys), 2), np.int64))
    assert len(models.missing(pa.array(["abc", "zzz"]))) == 0
    models = uf.Models(models.grams[:2] + [(k[:0], c[:0]) for k, c in models.grams[2:]], models.contexts[:2] + [tuple(x[:0] for x in c) for c in models.contexts[2:]], 2)
    asked = models.missing(pa.array(["abc", "abz", None]))
    whole = [uf._grams(w, k) >> np.uint64(8) for _, w in uf.Spelled(pa.array(["abc", "abz", None])).chunks() for k in range(2, uf.ORDER + 1)]
    # All but those that end in z, which was never seen.
    expected = {int(c) for c in np.concatenate(whole) if int(c) & 0xFF != ord("z")}
    assert set(asked.tolist()) == expected
