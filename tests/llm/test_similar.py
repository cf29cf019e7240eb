"""Near copies by shingle sets against brute force."""

import os
import random

import numpy as np

import corpus_pipeline
from lectern.llm import similar


def plain_sets(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    """Ids of the least of each component; a row is (id, text)."""
    sets, up = [plain_sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (no, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), no), no)
    return sorted(least.values())


def planted(n_bases=25, copies=9):
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage, rows = [draw.choice(vocabulary) for _ in range(40)], [(9001, ""), (9000, " \n"), (9002, "One two three"), (9003, "one two  three"), (9004, "one two three four")]
    for b in range(n_bases):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([6, 30, 120, 400]))] + (passage if b % 2 else [])
        for c in range(copies):
            words = list(base)
            for _ in range(draw.randrange(0, 1 + len(words) // 40) if c else 0):
                at = draw.randrange(len(words))
                words[at : at + draw.choice([0, 1, 1])] = [draw.choice(vocabulary)]
            rows.append((b * 100 + c, " ".join(words)))
    return rows


def test_stage_drops_planted_near_copies(spark, tmp_path):
    """Copies with a few changed words are many bits apart in their fingerprints, and 0.8 similar or more in their shingles."""
    rows = planted()
    want = brute_force(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, str(tmp_path)).collect()) == want
    assert len(want) < len(rows) / 2


def test_order_of_members_and_far_pairs_lose_nothing(spark, monkeypatch):
    """Most shingles common, and only the next one by size met at first."""
    monkeypatch.setattr(similar, "SAMPLED", 1)
    monkeypatch.setattr(similar, "COMMON", 2)
    monkeypatch.setattr(similar, "NEXT", 1)
    rows = planted(12, 14)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in similar.deduplicated(docs).collect()) == brute_force(rows)


def test_rows_and_columns_as_before(spark, documents):
    kept = similar.deduplicated(documents)
    assert kept.columns == documents.columns and kept.filter("text is null or trim(text) = ''").count() <= 1
    assert kept.filter("doc_id = 4").count() == 1 and kept.filter("doc_id = 5").count() == 0 and kept.filter("doc_id is null").count() == 1
    assert similar.deduplicated(documents.limit(0)).count() == 0


def test_columns_named_like_our_own_are_kept(spark):
    rows = [(1, "one two three four five six", "A", "k", True, "x"), (2, "one two three four five six", "B", "l", False, "y"), (3, "seven eight nine ten eleven twelve", "C", None, None, "z"), (3, "seven eight nine ten eleven twelve", "C", None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _key string, _no_id boolean, _c1 string")
    kept = similar.deduplicated(docs)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_a_large_group_of_near_copies_is_not_paired_off(spark, monkeypatch):
    """Texts a few words from one base: some are links, most are just too far apart, and all share members. Verified pairs are few a text."""
    draw, n = random.Random(5), 400
    base, rows, seen = [f"b{i}" for i in range(150)], [], []
    for no in range(n):
        words = list(base)
        for at in draw.sample(range(150), draw.choice([1, 2, 3, 4, 5])):
            words[at] = f"n{draw.randrange(10**6)}"
        rows.append((no, " ".join(words)))
    plain = similar._verified
    monkeypatch.setattr(similar, "_verified", lambda docs, nodes, pairs, *rest: (seen.append(pairs.count()), plain(docs, nodes, pairs, *rest))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in similar.deduplicated(docs).collect()) == brute_force(rows)
    assert sum(seen) < 30 * n


def test_sketches_of_a_bit_a_member_rule_out_no_similar_pair():
    """Most pairs that are clearly less similar go, also of sets far larger than the narrow sketch and of unlike sizes."""
    draw, dropped = np.random.default_rng(4), 0
    for n in (0, 1, 7, 500, 513, 1024, 1025, 20_000):
        a = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
        for share in (0, 0.02, 0.1, 0.11, 0.2, 0.4, 0.9):
            for more in (0, n // 8):
                b = np.unique(np.concatenate([a[round(share * n) :], draw.integers(0, 2**63, round(share * n) + more, dtype=np.uint64)]))
                able = similar.can_be_similar(similar.wide_sketch(a), len(a), similar.wide_sketch(b), len(b), 0.8)
                assert able == similar.can_be_similar(similar.wide_sketch(b), len(b), similar.wide_sketch(a), len(a), 0.8)
                assert able or len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b))
                if n >= 500 and share >= 0.2:
                    assert not able
                    dropped += 1
    assert dropped == 30


def test_what_is_stored_stays_well_below_the_texts(spark, monkeypatch):
    """Candidates carry sketches, and whole sets are made where two texts meet: no table holds members but the first one, once a set and task."""
    draw, size, plain = random.Random(12), {}, similar.materialize

    def stored(df, tag):
        out = plain(df, tag)
        size[tag] = size.get(tag, 0) + sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(similar, "materialize", stored)
    rows = []
    for b in range(30):
        base = [f"w{draw.randrange(5000)}" for _ in range(2500)]
        for c in range(6):
            words = list(base)
            for at in draw.sample(range(2500), 20 if c else 0):
                words[at] = f"w{draw.randrange(5000)}"
            rows.append((b * 100 + c, " ".join(words)))
    rows += [(5000 + i, rows[0][1]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in similar.deduplicated(docs).collect()) == [b * 100 for b in range(30)]
    assert sum(size.values()) < sum(len(t) for _, t in rows[:180])


def test_pairs_are_verified_in_slices(spark, monkeypatch):
    """More ends of pairs than are broadcast: some slices, or texts joined by a shuffle; repeated rows, nulls and texts that are one another's copies."""
    rows = planted(8, 8)
    rows += [(None, rows[20][1]), (rows[30][0], rows[30][1]), (None, None), (77, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_force([(9999 if no is None else no, t) for no, t in rows])
    for ends, slices in ((40, 64), (3, 2)):
        monkeypatch.setattr(similar, "BROADCAST_ROWS", ends)
        monkeypatch.setattr(similar, "SLICES", slices)
        assert sorted(9999 if r.doc_id is None else r.doc_id for r in similar.deduplicated(docs).collect()) == want
