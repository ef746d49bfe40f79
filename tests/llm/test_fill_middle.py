import hashlib
import random
import re

import numpy as np
import pytest

from msgsearch.llm import fill_middle as fm

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MARKED = re.compile("<[PSM]>")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    low, high = sorted(h % (len(units) + 1) for h in (h1, h2))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or MARKED.search(text) or h3 % 100 >= 50:
        return (doc_id, len(units), "plain", None, None, text, text)
    if h4 % 100 < 80:
        return (doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text)
    return (doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text)


def digested(row):
    return (*row[:5], sha(row[5]), sha(row[6]))


def some_texts(many):
    rng = random.Random(13)
    pieces = ["a", "word", " ", "  ", "\t\n", "\r", "\x0b\x0c", "é", "日本語", "🙂", "\x1f", "\x7f", " ", " ", "<", "P>", "<S", "\x08", "\x0e", "!", "\x00"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(many)]
    return rows + [(many + i, t) for i, t in enumerate(["", None, " ", "\n \t", "x", " x", "x ", "has <P> in it", "<M>", "a<S>"])]


def test_every_column_by_hand(texts):
    rows = some_texts(600) + [(7, "equal rows here"), (7, "equal rows here"), (None, "no id, some words " * 3)]
    got = sorted(map(tuple, fm.fill_digests(texts(*rows)).collect()), key=str)
    assert got == sorted((digested(by_hand(*r)) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_are_whole(texts):
    rows = some_texts(200)
    got = {r.doc_id: r for r in fm.transform(texts(*rows)).collect()}
    for row in rows:
        want = by_hand(*row)
        assert tuple(got[row[0]])[:6] == want[:6]


@pytest.mark.parametrize("size", [1, 7, 8, 9, 63, 64, 65, 1000])
def test_rank_and_select_agree_with_counting(size):
    rng = np.random.default_rng(size)
    data = rng.choice(np.frombuffer(b"ab \t\n\x80\xc3", np.uint8), size)
    bounds = np.unique(np.append(rng.integers(0, size + 1, 5), [0, size]))
    marked = fm.unit_ends(data, bounds)
    at = np.flatnonzero(marked.view(np.uint8)[:size])
    blank = np.isin(data, np.frombuffer(b" \t\n", np.uint8))
    last = np.isin(np.arange(1, size + 1), bounds)
    following = np.append(blank[1:], True)
    assert at.tolist() == np.flatnonzero((~blank & following) | last).tolist()
    marks = fm.Marks(marked)
    assert marks.rank(np.arange(size + 1)).tolist() == [int((at < i).sum()) for i in range(size + 1)]
    assert marks.select(np.arange(1, len(at) + 1)).tolist() == at.tolist()


def test_every_byte_is_classed():
    words = np.arange(256, dtype=np.uint8).view("<u8")
    found = np.flatnonzero(fm.separators(words).view(np.uint8))
    assert found.tolist() == [9, 10, 11, 12, 13, 32]


def test_very_long_text_and_clashing_columns(texts):
    long = "wordé " * 600_000
    rows = [(i, long if i == 4 else f"text {i}") for i in range(8)] + [(11, "z" * 3_000_000)]
    frame = texts(*rows, extra="1 AS n").selectExpr("*", "2 AS h1", "3 AS output", "4 AS form")
    got = sorted(map(tuple, fm.fill_digests(frame).collect()))
    assert got == sorted(digested(by_hand(*r)) for r in rows)


def test_empty_table(texts):
    none = fm.fill_digests(texts((1, "a")).where("false"))
    assert none.count() == 0
    assert none.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
