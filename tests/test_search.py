import math
import random

import pytest
from pyspark.sql import functions as F

from lectern import catalogue
from lectern.functions import text as X
from lectern.operators import blocks, search


def test_cosine_and_nulls(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([], [1.0]), ([0.0], [1.0]), ([3.0, 4.0, 9.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = [r.c for r in rows.select(X.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[:4] == [pytest.approx(math.sqrt(0.5)), 0.0, 0.0, 0.0] and 0 < got[4] < 1


def chunk_rows(spark):
    rows = [(1, 1, "red apples and green apples", [1.0, 0.0]), (2, 1, "green tea", [0.9, 0.1]), (3, 2, "blue sea", None), (4, 2, "Apples, again", [0.0, 1.0]), (5, 2, None, [0.0, 0.0])]
    return spark.createDataFrame(rows, "chunk_id long, document_id long, content string, vector array<double>")


def test_knn_skips_null_vectors_filters_and_breaks_ties(spark):
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, None)], "qid int, vector array<double>")
    got = [(r.qid, r.chunk_id) for r in search.knn(chunk_rows(spark), asked, 2).orderBy("qid", "rank").collect()]
    assert got == [(0, 1), (0, 2), (1, 4), (1, 2)]
    assert {r.chunk_id for r in search.knn(chunk_rows(spark), asked, 9, [2]).collect()} == {4, 5}
    assert search.knn(chunk_rows(spark), asked, 9, []).count() == search.knn(chunk_rows(spark), asked, 9).count() == 8
    assert search.knn(chunk_rows(spark), asked.limit(0), 9).count() == 0


def test_bm25_by_hand_and_blank_questions(spark):
    asked = spark.createDataFrame([(0, "apples"), (1, " ,; "), (2, None), (3, "green zebra")], "qid int, text string")
    got = search.bm25(chunk_rows(spark), asked).orderBy("qid", "rank").collect()
    n, df, avgdl = 5, 2, 11 / 5
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    score = lambda tf, dl: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert {(r.qid, r.chunk_id): r.score for r in got if r.qid == 0} == {(0, 4): pytest.approx(score(1, 2)), (0, 1): pytest.approx(score(2, 5))}
    assert {r.qid for r in got} == {0, 3}
    same = search.bm25(chunk_rows(spark), asked, wanted=["apples", "green", "zebra"]).orderBy("qid", "rank").collect()
    assert same == got
    filtered = search.bm25(chunk_rows(spark), asked, document_ids=[2]).collect()
    assert [(r.qid, r.chunk_id, r.score) for r in filtered] == [(0, 4, pytest.approx(score(1, 2)))]


def test_fusion_by_hand(spark):
    lists = spark.createDataFrame([(0, 0, 1, 1), (0, 0, 2, 2), (0, 1, 1, 2), (0, 1, 2, 3)], "qid int, list_no int, rank int, chunk_id long")
    ranked = search.top(search.fuse(lists), ["qid"], search.fused_order(), 9).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in ranked] == [(2, pytest.approx(1 / 62 + 1 / 61)), (1, pytest.approx(1 / 61)), (3, pytest.approx(1 / 62))]
    shuffled = search.fuse(lists.orderBy(F.rand(3)))
    assert sorted(r.chunk_id for r in shuffled.collect()) == [1, 2, 3]


def test_rounds_keep_the_best_score_and_count_new_chunks(spark):
    rounds = spark.createDataFrame([(0, 1, 1, 0.5, (0, 1)), (0, 1, 2, 0.4, (0, 2)), (0, 2, 1, 0.2, (0, 1)), (0, 2, 2, 0.9, (1, 1)), (0, 2, 3, 0.1, (1, 2)), (0, 3, 3, 0.1, (0, 1))], "qid int, round int, chunk_id long, score double, first struct<list_no:int,rank:int>")
    got = {r.chunk_id: (r.score, r.round) for r in search.accumulate(rounds).collect()}
    assert got == {1: (0.5, 1), 2: (0.9, 1), 3: (0.1, 2)}
    assert [(r.round, r.new_chunks, r.total_chunks) for r in search.round_counts(rounds).orderBy("round").collect()] == [(1, 2, 2), (2, 1, 3), (3, 0, 3)]


def slow_mmr(pool, lam, top_n):
    def cos(a, b):
        if not a or not b:
            return 0.0
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    picked, left = [], list(pool)
    while left and len(picked) < top_n:
        value = (lambda c: c[1]) if not picked else (lambda c: lam * c[1] - (1 - lam) * max(cos(c[2], p[2]) for p in picked))
        best = max(left, key=lambda c: round(value(c), 12))
        picked.append(best)
        left.remove(best)
    return [c[0] for c in picked]


@pytest.mark.parametrize("lam", [0.0, 0.5, 1.0])
def test_mmr_equals_the_greedy_loop(spark, lam):
    draw = random.Random(3)
    pools = {q: [(i + 10 * q, draw.choice([0.5, 0.25, 0.9, draw.random()]), draw.choice([None, [draw.random(), draw.random()], [1.0, 0.0], [0.0, 0.0]])) for i in range(n)] for q, n in enumerate((1, 5, 17))}
    rows = [(q, pos, c, s, v) for q, pool in pools.items() for pos, (c, s, v) in enumerate(pool, 1)]
    df = spark.createDataFrame(rows, "qid int, pos int, chunk_id long, score double, vector array<double>")
    got = {}
    for r in search.mmr(df, lam, 6).orderBy("qid", "pick").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    assert got == {q: slow_mmr(pool, lam, 6) for q, pool in pools.items()}


def test_pool_and_penalty(spark):
    rows = spark.createDataFrame([(0, 1, 0.9, True), (0, 2, 0.5, False), (0, 3, 0.1, False)], "qid int, chunk_id long, score double, is_references boolean")
    assert [r.chunk_id for r in search.pool(search.penalise(rows, 0.3), [F.desc("score"), F.asc("chunk_id")], 0.2, 2).orderBy("pos").collect()] == [2, 1]
    assert {r.score for r in search.penalise(rows, 1.0).collect()} == {0.9, 0.5, 0.1}


def test_references_headings(spark):
    rows = spark.createDataFrame([("References",), ("FURTHER READING ",), ("1.4 Bibliography",), ("User Preferences",), ("References to work",), ("",), (None,)], "h string")
    assert [r.f for r in rows.select(X.is_references(F.col("h")).alias("f")).collect()] == [True, True, True, True, False, False, False]


def test_blocks_in_order_with_provenance(spark):
    sections = spark.createDataFrame([(1, 1, "1", 1, "one"), (2, 1, "1.2", 2, "s"), (3, 1, "10", 1, None), (4, 1, "10.1", 2, "t"), (5, 2, "1", 1, "other"), (6, 2, "7.1", 2, "orphan")], "section_id long, document_id long, path string, depth int, full_text string")
    titles = spark.createDataFrame([(1, "Book"), (2, None)], "document_id long, title string")
    chosen = spark.createDataFrame([(0, 1, 100, 4), (0, 2, 101, 2), (0, 3, 102, 4), (0, 4, 103, None), (0, 5, 104, 6), (0, 6, 105, 5)], "qid int, pos int, chunk_id long, section_id long")
    got = blocks.expand(chosen, sections, titles).orderBy("block_pos").collect()
    assert [(r.section_id, r.full_text, r.source, list(r.from_chunks)) for r in got] == [(3, "", "Book › 10", [100, 102]), (1, "one", "Book › 1", [101]), (5, "other", "None › 1", [105])]
    above = {(r.section_id, r.ancestor_id) for r in blocks.ancestors(sections).collect()}
    assert (2, 1) in above and (4, 3) in above and (4, 1) not in above and (6, 5) not in above


@pytest.mark.parametrize(("answer", "cited"), [("see [Book › 4] and [book, 1.4.6]", ["Book › 4", "Book › 1"]), ("Book chapter 4", []), ("[Other › A] then [Book 9]", ["Other › A"]), ("[Book] 4", []), ("", [])])
def test_citations_stand_in_brackets(spark, answer, cited):
    rows = spark.createDataFrame([(0, answer, ["Book › 4", "Book › 1", "Other › A", "Book › 4", "Plain"])], "qid int, answer string, sources array<string>")
    assert blocks.cited_sources(rows).first().cited == cited


def test_frames_hold_text_back(spark):
    parts = [(0, i, "x" * n) for i, n in enumerate([150, 60, 10, 250, 5])] + [(1, 0, "")]
    got = blocks.delta_frames(spark.createDataFrame(parts, "qid int, seq int, text string")).orderBy("qid", "frame_no").collect()
    assert [(r.qid, r.frame_no, len(r.frame)) for r in got] == [(0, 1, 210), (0, 2, 260), (0, 3, 5)]


def test_evidence_and_recall(spark):
    pooled = spark.createDataFrame([(0, 1, 9, "B › 1"), (0, 2, 8, "A › 2"), (0, 3, 7, "B › 3")], "qid int, pos int, chunk_id long, source string")
    assert [(r.document, list(r.chunk_ids)) for r in blocks.evidence_by_document(pooled).orderBy("doc_pos").collect()] == [("B", [9, 7]), ("A", [8])]
    ranked = spark.createDataFrame([(0, 1, "5"), (0, 2, "3"), (1, 7, "3")], "qid int, rank int, key string")
    expected = spark.createDataFrame([(0, "3"), (0, "4"), (1, "3"), (2, "1")], "qid int, key string")
    assert [(r.qid, r.first_rank, r.hit) for r in search.recall_at_k(ranked, expected).orderBy("qid").collect()] == [(0, 2, True), (1, 7, False), (2, None, False)]


def test_vectors_with_odd_numbers_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [0.0, 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [float("nan"), 0.0])], "qid int, vector array<double>")
    assert [(r.qid, r.chunk_id) for r in search.knn(chunks, asked).orderBy("rank").collect()] == [(0, 1), (0, 5)]


def test_terms_are_sought_or_joined_alike(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"word{i % 3} word{i % 2} other", i) for i in range(9)], "chunk_id long, content string, document_id long")
    asked = spark.createDataFrame([(0, "word1 nothing"), (1, "other word2")], "qid int, text string")
    found = search.bm25(chunks, asked).collect()
    monkeypatch.setattr(search, "MAX_TERMS", 1)
    assert sorted(found) == sorted(search.bm25(chunks, asked).collect()) and len(found) > 5


def test_texts_are_not_exchanged_to_meet_vectors(spark, tmp_path):
    """Passages are the chunks without their vectors, also where an id has several or none; the texts go through no join unless it has several."""
    docs = [(i, f"text {i}", "src", "en") for i in range(30)] + [(None, "no id", "src", "en")]
    for name, ids in (("one", [1, 2, 3, 99, None]), ("several", [1, 2, 2, 2, 5, 5, 99, None, None])):
        d = str(tmp_path / name)
        spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(i, [1.0, float(i or 0)]) for i in ids], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
        got, want = catalogue.passages(spark, d), catalogue.chunks(spark, d).drop("vector")
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert ("Join" in got._jdf.queryExecution().optimizedPlan().toString()) == (name == "several")
        tops = {(r.document_id, r.path): (r.section_id, r.full_text) for r in catalogue._sections(spark, d).filter("depth = 1").collect()}
        assert tops.pop((None, None)) == (None, None) and len(tops) == 30
        assert all(t == (-i - 1, f"text {i}") for i, t in enumerate(tops[i % 20, str(i % 7 + 1)] for i in range(20)))
