"""The prefix-tree join against all pairs of sets."""

import random

import numpy as np
import pytest

from lectern.llm import prefix_join, similar


def plain_set(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\v", " ").split(" ")]
    words = [w for x in words for w in x.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\f", " ").split(" ") if w]
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain(rows):
    sets, up = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (no, _) in enumerate(rows):
        if no is not None:
            least[find(i)] = min(least.get(find(i), no), no)
    return sorted(((no, len(s), least.get(find(i)) if s else no) for i, ((no, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def texts(seed=4, bases=30, copies=10):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    passage = [draw.choice(words) for _ in range(60)]
    rows = [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One two"), (9004, "one  TWO"), (9005, "one two three"), (None, "one two"), (None, "no id at all"), (9006, "É one two"), (9007, "é one two"), (9008, "a b c d"), (9009, "x " * 40), (9010, "x x x")]
    for b in range(bases):
        base = [draw.choice(words) for _ in range(draw.choice([4, 25, 90, 300]))] + (passage if b % 2 else [])
        for c in range(copies):
            mine = list(base)
            for _ in range(draw.randrange(0, 1 + len(mine) // 50) if c else 0):
                at = draw.randrange(len(mine))
                mine[at : at + draw.choice([0, 1, 1])] = [draw.choice(words)]
            rows.append((b * 100 + c, " ".join(mine)))
    return rows + [rows[40], rows[40], (7, "long " + " ".join(f"t{i % 4000}" for i in range(30_000)))]


@pytest.mark.parametrize("changed", [{}, {"TAIL": 2, "NEXT": 1, "block": 4, "SAMPLED": 1, "COMMON": 2}])
def test_components_equal_those_of_all_pairs(spark, monkeypatch, changed):
    for name in ("TAIL", "NEXT"):
        monkeypatch.setattr(prefix_join, name, changed.get(name, getattr(prefix_join, name)))
    for name in ("SAMPLED", "COMMON"):
        monkeypatch.setattr(similar, name, changed.get(name, getattr(similar, name)))
    rows = texts()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, size int").repartition(3)
    got = prefix_join.components_of(docs, block_rows=changed.get("block", prefix_join.BLOCK_ROWS))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    found, want = sorted(map(tuple, got.collect()), key=str), plain(rows)
    assert found == want
    assert sum(no != root for no, _, root in want) > 100 and len({r[2] for r in want}) > 40


def test_walks_leave_out_only_what_cannot_be_similar():
    """Each pair that shares the key first and is similar is found; walks need far fewer fits than all pairs."""
    draw = random.Random(3)
    key, sets = 1, []
    for _ in range(12):
        base = draw.sample(range(2, 5000), 120)
        for _ in range(20):
            mine = set(base) - set(draw.sample(base, draw.randrange(8))) | set(draw.sample(range(2, 5000), draw.randrange(5)))
            sets.append([key, *sorted(mine)])
    for tail in (3, 200):
        trie, found = prefix_join.Trie(0.9), set()
        for no, x in enumerate(sets):
            found |= {(other, no) for other in trie.walk(len(x), len(x) - 1, x[1 : 1 + tail])}
            trie.add(len(x), len(x) - 1, x[1 : 1 + tail])
        good = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(set(sets[i]) & set(sets[j])) >= 90 * len(set(sets[i]) | set(sets[j]))}
        assert good <= found and len(good) > 500
        assert tail == 3 or found == good


def test_sketches_never_rule_out_similar_sets():
    draw = np.random.default_rng(6)
    for n in (5, 200, 5000):
        a = draw.integers(0, 2**63, n, dtype=np.uint64)
        for change in (0, n // 40, n // 3):
            b = np.concatenate([a[change:], draw.integers(0, 2**63, change, dtype=np.uint64)])
            differ = len(np.setxor1d(a, b))
            bits = (int.from_bytes(prefix_join.sketch(np.unique(a))) ^ int.from_bytes(prefix_join.sketch(np.unique(b)))).bit_count()
            assert bits <= differ and (n > 200 or bits >= differ * 0.7)


def test_no_documents(spark):
    assert prefix_join.components_of(spark.createDataFrame([], "doc_id long, text string")).count() == 0
