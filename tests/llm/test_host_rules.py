import re
from collections import Counter

import pytest

from msgsearch.llm import host_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "a b c d e f g h " * 4,
    "x " * 300,
    "line one is here\nline one is here\n \n \nother # * $ | <b> & %",
    " ".join(str(i % 13) for i in range(200)) + " tail é 日本 \x85x",
    "w " * 8 + "q " * 20 + "w " * 8,
]


def test_measures_equal_brute_force(texts):
    rows = host_rules.measure(texts(*enumerate(TEXTS))).collect()
    for row in rows:
        assert tuple(row[m] for m in host_rules.MEASURES) == brute(TEXTS[row.doc_id]), row.doc_id


def test_bad_host_loses_all_and_small_host_is_shrunk(texts):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good, "en", f"h{i % 9}") for i in range(180)]
    rows += [(1000 + i, good if i % 5 == 0 else "too short", "en", "bad") for i in range(200)]
    rows += [(2000, "short", "en", "tiny"), (2001, good, "en", "tiny"), (2002, good, None, None), (2003, None, "en", "h1")]
    found = {r.doc_id: r for r in host_rules.judge(texts(*rows)).collect()}
    assert len(found) == len(rows)
    assert not any(found[1000 + i].kept for i in range(200))
    assert found[1000].host_failed and not found[1000].base_failed
    assert found[2001].kept and not found[2000].kept
    assert found[2002].kept and found[2002].host_rate is None
    assert found[2003].base_failed and not found[2003].kept


def test_repeats_clashes_and_empty(texts):
    good = " ".join(f"word{i}" for i in range(30))
    frame = texts((1, good, "en", "a"), (1, good, "en", "a"), (None, good, "en", "a"), extra="7 AS n_words").selectExpr("*", "'x' AS kept", "1 AS docs")
    rows = host_rules.judge(frame).collect()
    assert len(rows) == 3 and all(r.kept is True and r.n_words == 30 for r in rows)
    assert host_rules.judge(texts((1, "a", "b", "c")).where("false")).count() == 0


def test_small_hosts_count(texts):
    """No host reaches five documents; those that fail all of theirs go, whatever their size."""
    good = " ".join(f"word{i}" for i in range(30))
    sizes = {h: 1 + h % 4 for h in range(60)}
    rows = [(100 * h + i, "bad" if h % 5 == 0 else good, "en", f"h{h}") for h, n in sizes.items() for i in range(n)]
    rows += [(100_000, good, "en", "h0")]
    found = {r.doc_id: r for r in host_rules.judge(texts(*rows)).collect()}
    for h, n in sizes.items():
        if h % 5:
            assert all(found[100 * h + i].kept for i in range(n))
        elif n > 1:
            assert all(found[100 * h + i].host_failed for i in range(n))
    assert not found[100_000].base_failed and found[100_000].kept == (sizes[0] < 2)


def test_prior_follows_the_moments(spark):
    rates = [(n, f) for n, f in [(1, 0), (1, 1), (2, 0), (3, 3), (4, 1), (7, 0), (50, 10), (200, 90)] for _ in range(3)]
    failed, passed = host_rules.beta_prior(spark.createDataFrame(rates, "docs bigint, failed bigint"))
    n, f = sum(r[0] for r in rates), sum(r[1] for r in rates)
    m, k = f / n, len(rates)
    s = sum(a * (b / a - m) ** 2 for a, b in rates)
    r = (s / (m * (1 - m)) - (k - 1)) / (n - sum(a * a for a, _ in rates) / n - (k - 1))
    assert failed + passed == pytest.approx(1 / r - 1) and failed / (failed + passed) == pytest.approx(m)


def test_very_long_texts(texts):
    unique = " ".join(f"w{i}" for i in range(150_000))
    rows = [unique, unique + " " + " ".join(f"w{i}" for i in range(8)), "same " * 150_000]
    found = {r.doc_id: r for r in host_rules.measure(texts(*enumerate(rows))).collect()}
    assert [found[i].n_repeat_words for i in range(3)] == [0, 16, 150_000]


def test_passing_keeps_whole_rows(texts):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(1, good, "en", "a"), (1, good, "en", "a"), (2, "short", "en", "a"), (None, good, None, None), (3, None, "en", "a")]
    frame = texts(*rows, extra="5 AS _twin")
    assert sorted(r.doc_id or 0 for r in host_rules.passing(frame).collect()) == [0, 1, 1]


def test_stays_native(texts):
    plan = host_rules.judge(texts((1, "a", "b", "c")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("rates", [[(10, 1)], [(10, 5), (10, 5)], [(10, 0), (10, 10)], []])
def test_prior_is_defined(spark, rates):
    hosts = spark.createDataFrame(rates, "docs bigint, failed bigint")
    a, b = host_rules.beta_prior(hosts)
    assert a > 0 and b > 0
