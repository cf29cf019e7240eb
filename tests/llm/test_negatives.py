"""Hard negatives against all inner products."""

import math
import random

import numpy as np

from lectern.llm import negatives


def plain(rows):
    fine = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    anchors = {}
    for i, label, v in fine:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for i, other, w in fine if i != a and len(w) == len(v))
        for p, positive, _ in [x for x in scored if x[2]][:5]:
            window = [x for x in scored if not x[2] and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(a, positive, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(window)]
    return sorted(out)


def vectors(n=700, dims=8):
    draw = random.Random(5)
    centres = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = [(i, draw.randrange(3), [float(np.float32(c + draw.gauss(0, 0.4))) for c in draw.choice(centres)]) for i in range(-100, n)]
    rows += [(1000 + i, i % 3, rows[7][2]) for i in range(60)]  # one vector many times
    rows += [(100, 0, rows[3][2]), (100, 2, rows[9][2]), (41, 1, rows[41][2]), (41, 1, rows[41][2])]  # ids that stand twice
    rows += [(2000, None, rows[1][2]), (2100, 1, None), (2200, 1, [None] * dims), (2300, 1, [math.nan] * dims), (2400, 2, [math.inf] * dims), (None, 1, rows[2][2])]
    rows += [(2500, 1, [0.0] * dims), (2600, 1, []), (2601, 1, []), (2602, 2, [])]
    return rows + [(i, i % 2, [draw.gauss(0, 1) for _ in range(3)]) for i in range(3000, 3120)]  # another length


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, rank string").repartition(3)


def test_equals_all_products(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 64), ("BLOCK_ROWS", 3), ("STEP", 16)):
        monkeypatch.setattr(negatives, name, value)
    got = negatives.hard_negatives(table(spark, vectors()))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(vectors())
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_scores_beyond_doubles_are_exact(spark):
    draw = random.Random(2)
    rows = [(i, i % 2, [float(draw.randrange(10**6, 10**6 + 3)) for _ in range(3)]) for i in range(0, 300, 5)]
    want = plain(rows)
    assert sorted(map(tuple, negatives.hard_negatives(table(spark, rows)).collect())) == want and want and max(r[4] for r in want) > 2**53


def test_rings_leave_out_most_of_what_has_structure():
    """Clusters far apart: an anchor's scan forms few of all products, and finds the same."""
    draw = np.random.default_rng(1)
    rows = np.concatenate([np.floor(256 * (c + draw.normal(0, 0.05, (1000, 6)))) for c in draw.normal(0, 3, (8, 6))])
    top = float((rows**2).sum(axis=1).max())
    pivots = negatives.raised(negatives.far_apart(rows[::40], 8), top)
    space, d = (top, False, pivots), negatives.distances(negatives.raised(rows, top), pivots)
    vectors = rows[::400]
    at = np.sqrt((vectors**2).sum(axis=1)[:, None] + top - 2 * (vectors @ pivots[:, :-1].T))
    formed, score = 0, np.full((len(vectors), 5), -np.inf)
    for i in range(len(vectors)):  # the nearest pivots first, as rounds do
        for p in np.argsort(np.abs(at[i])):
            own = np.flatnonzero(d.argmin(axis=1) == p)
            own = own[np.argsort(d[own, p])]
            if not len(own):
                continue
            block = (np.array([-1]), np.array([1]), at[i : i + 1], vectors[i : i + 1], [[(None, score[i, -1])]])
            _, found, _, n = negatives.scan(block, (own, np.ones(len(own), dtype=int), d[own, p], rows[own]), int(p), space, True, 5, 32)
            score[i] = np.sort(np.concatenate([score[i], found]))[::-1][:5]
            formed += n
    assert (score == np.sort(vectors @ rows.T, axis=1)[:, ::-1][:, :5]).all()
    assert formed < 0.6 * len(vectors) * len(rows)


def test_no_rows(spark):
    assert negatives.hard_negatives(table(spark, [])).count() == 0
