"""Operators on pairs against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lectern.llm import ann, components, simhash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    n = len(ids)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                up[find(i)] = find(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(n)]


def near_texts(n):
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdefg") for _ in range(4)) for _ in range(60)]
    bases = [[draw.choice(vocabulary) for _ in range(draw.choice([3, 40, 400]))] for _ in range(12)]
    out = []
    for i in range(n):
        words = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 3])):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        out.append((i * 3 + 1, " ".join(words)))
    return out


def check_components(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, **options).collect()), key=str)
    fps = [slow_fingerprint(t) for _, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, slow_components([i for i, _ in rows], fps))), key=str)
    assert got == want


def test_components_equal_brute_force(spark):
    check_components(spark, near_texts(250) + [(900, ""), (901, None), (2, " \n"), (None, "abcd efga"), (None, None)])


def test_large_keys_take_the_other_way(spark):
    check_components(spark, near_texts(250), large_key=2)


def test_long_chains_of_links(spark):
    """Fingerprints that differ from the next in one bit only: far ends reach each other."""
    chain = [(1 << i) - 1 for i in range(0, 60)]
    fps = spark.createDataFrame([(c,) for c in chain], "fp long")
    for large in (1, 512):
        roots = components.components(simhash.links(fps, large_key=large)).collect()
        assert {r.root for r in roots} == {0} and len(roots) == len(chain)


def test_all_links_at_two_bits_are_found(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(63) for _ in range(6)]
    fps = sorted({b ^ (1 << draw.randrange(63)) ^ (1 << draw.randrange(63)) for b in base for _ in range(120)} | set(base))
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = slow_components(fps, fps)
    for large in (3, 10_000):
        placed = {r.node: r.root for r in components.components(simhash.links(table, large_key=large)).collect()}
        assert [placed.get(f, f) for f in fps] == want


def test_pivots_discard_but_never_lose():
    draw = np.random.default_rng(1)
    fps = draw.integers(0, 1 << 12, 400, dtype=np.uint64)
    a, b = simhash.linked_pairs(np.zeros(400, dtype=int), fps, simhash.pivots(), 2)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(400) for j in range(i + 1, 400) if int(fps[i] ^ fps[j]).bit_count() <= 2}


def test_deduplicated_keeps_one_of_each_group_and_all_columns(spark, documents):
    kept = simhash.deduplicated(documents)
    assert kept.columns == documents.columns
    assert sorted(kept.collect(), key=str) == sorted([r for r in documents.distinct().collect() if r.doc_id not in (2, 5, 7)], key=str)
    empty = documents.limit(0)
    assert simhash.deduplicated(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def vectors():
    draw = np.random.default_rng(2)
    v = draw.normal(size=(700, 8))
    v[300:420] = v[7] + draw.normal(scale=0.01, size=(120, 8))
    v[500:560] = v[50]
    return [(i, [float(x) for x in np.float32(row)], "x") for i, row in enumerate(v)]


def test_exact_search_equals_brute_force(spark):
    rows = vectors() + [(1000, None, "x"), (1050, [0.0] * 8, "x"), (1100, [float("nan")] * 8, "x"), (1150, [None] * 8, "x"), (None, [1.0] * 8, "x"), (1200, [float("inf")] * 8, "x"), (1250, [], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string").repartition(4)
    got = {}
    for r in ann.nearest(table, factor=1.0, shard_rows=100, query_rows=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    v = np.array([r[1] for r in rows[:700]])
    assert sorted(got) == list(range(0, 700, 50))
    for q, found in got.items():
        cos = ann.cosines(v[q : q + 1], v)[0]
        want = sorted((i for i in range(700) if i != q), key=lambda i: (-cos[i], i))[:5]
        assert [i for i, _ in found] == want and np.allclose([s for _, s in found], cos[want], atol=1e-12)
    assert ann.nearest(table.limit(0)).count() == 0
    few = ann.nearest(table.filter("vec_id < 3 or vec_id = 50"))
    assert few.filter("query_id = 0").count() == 3


def test_relaxed_search_prunes_and_recall_is_measured():
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(40, 16))
    v = np.repeat(centres, 50, axis=0) + draw.normal(scale=0.15, size=(2000, 16))
    ids = np.arange(2000)
    tree = ann.build(ids, v)
    exact, _, all_seen = ann.search(tree, ids[::50], v[::50], factor=1.0)
    loose, _, seen = ann.search(tree, ids[::50], v[::50], factor=1.5)
    recall = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(exact, loose)])
    assert recall >= 0.9 and seen < all_seen < 40 * 2000


def test_components_of_repeated_and_self_links(spark):
    edges = spark.createDataFrame([(1, 1), (5, 4), (4, 5), (4, 9), (7, 8)], "a long, b long")
    assert sorted((r.node, r.root) for r in components.components(edges).collect()) == [(4, 4), (5, 4), (7, 7), (8, 7), (9, 4)]
    assert components.components(edges.filter(F.lit(False))).count() == 0


def test_cosines_sum_in_order_and_stay_in_range():
    draw = np.random.default_rng(3)
    a, b = draw.normal(size=(4, 64)), draw.normal(size=(9, 64))
    want = [[float(np.cumsum(x * y)[-1] / np.sqrt(np.cumsum(x * x)[-1] * np.cumsum(y * y)[-1])) for y in b] for x in a]
    assert ann.cosines(a, b).tolist() == want
    assert np.allclose(ann.cosines(a * 1e120, b * 1e120), want) and np.allclose(ann.cosines(a * 1e-120, b * 1e-120), want)


def test_negative_repeated_and_ragged_vectors(spark):
    draw = np.random.default_rng(9)
    v = {i: [float(x) for x in np.float32(row)] for i, row in zip(range(-60, 60), draw.normal(size=(120, 4)))}
    rows = [*v.items(), (0, v[0]), (0, v[0]), (-50, v[7]), (3, v[3]), (1000, [1.0, 2.0]), (1050, [1.0] * 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann.nearest(table, shard_rows=30, query_rows=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(got) == [-50, 0, 50]
    usable = [r for r in rows if len(r[1]) == 4]
    for q, found in got.items():
        own = np.array([min(x for i, x in usable if i == q)])
        others = [(i, x) for i, x in usable if i != q]
        cos = ann.cosines(own, np.array([x for _, x in others]))[0]
        assert found == [others[j][0] for j in sorted(range(len(others)), key=lambda j: (-cos[j], others[j][0]))[:5]]


def test_vectors_of_each_length_meet_their_own(spark):
    rows = [(50, [1.0, 0.0, 0.0]), (51, [0.9, 0.1, 0.0]), (52, [0.0, 1.0, 0.0]), (100, [1.0, 0.0]), (101, [0.5, 0.5]), (102, [0.0, 1.0]), (103, [1.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(50, 51), (50, 52), (100, 101), (100, 103), (100, 102)]
