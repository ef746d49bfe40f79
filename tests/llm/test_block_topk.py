import numpy as np
import pytest

from msgsearch.llm import block_topk as bt


def brute(rows, k=5, every=50):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in kept:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in kept if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


@pytest.mark.parametrize("each", [16384, 100])
def test_equals_brute_force(spark, monkeypatch, each):
    monkeypatch.setattr(bt, "VECTORS_EACH", each)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    rows += [(1000 + i, rows[100][1]) for i in range(40)] + [(2000, None), (2050, [1.0, None]), (2100, [float("nan")]), (2150, [float("inf")])]
    rows += [(3000, []), (3050, [0.5, -0.25]), (None, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS score", "'x' AS vector")
    found = {tuple(r) for r in bt.embedding_neighbours(frame).collect()}
    assert found == brute(rows)
    assert bt.embedding_neighbours(frame.where("false")).count() == 0


def test_blocks_are_pruned():
    ids = np.arange(1280)
    matrix = np.zeros((1280, 4))
    matrix[:, 0] = ids // 128
    blocks = bt.Blocks(ids, matrix)
    query = np.array([[2.0, 0, 0, 0]])
    found, scores = blocks.best(-1, query[0], blocks.bounds(query)[0], 5)
    assert found.tolist() == [1152, 1153, 1154, 1155, 1156] and blocks.scored == 128


def test_large_components_are_exact(spark):
    """Scores around 2^53, around 2^62 and beyond a long, among ordinary ones, from both sides."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    for i in range(0, 300, 25):
        big = 10.0 ** int(rng.integers(3, 13))
        rows[i] = (i, [float(x) * big for x in rng.normal(size=4)])
    rows += [(400, [1e300, -1e300, 0.0, 1e308]), (401, [1e20, 1.0, 1.0, 1.0]), (402, [-1e20, 0.0, 0.0, 0.0]), (450, [0.0] * 4), (500, [1.7e308, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {tuple(r) for r in bt.embedding_neighbours(frame).collect()}

    def whole(x):
        scaled = min(bt.LARGEST, max(-bt.LARGEST, 256 * x))
        return int(np.floor(scaled))

    kept = [(i, [whole(x) for x in v]) for i, v in rows]
    want = set()
    for i, q in kept:
        if i % 50 == 0:
            scored = sorted((-min(bt.HIGH, max(bt.LOW, sum(a * b for a, b in zip(q, v)))), j) for j, v in kept if j != i)[:5]
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    assert found == want
    assert any(s >= 1 << 53 for *_, s in found) and any(s == bt.HIGH for *_, s in found)


def test_tiers_bound_the_scores():
    matrix = np.array([[1.0, 2.0], [6e7, 0.0], [7e7, 1.0], [1.5e9, 1.5e9], [1.6e9, 0.0], [1e300, 0.0]])
    tiers = bt._tiers(matrix)
    assert tiers.tolist() == [0, 0, 1, 1, 2, 2]
    for tier, rows in bt._by(tiers)[:2]:
        most = max(sum(abs(int(x)) * abs(int(y)) for x, y in zip(a, b)) for a in matrix[rows] for b in matrix[rows])
        assert most < bt.EXACT[tier]
