import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import search
from lectern.operators.text_index import TextIndex


@pytest.fixture(scope="module")
def chunks(spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, i % 7, " ".join(draw.choices(words, weights=[1 / (j + 1) for j in range(300)], k=draw.choice([3, 20, 60])))) for i in range(1500)]
    return spark.createDataFrame([*rows, (9001, 1, None), (9002, 1, " ,; "), (9003, 2, "w5 " * 400)], "chunk_id long, document_id long, content string").repartition(3)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(0, "w0 w1"), (1, "w150, W200 w299"), (2, "w0 w77 nowhere"), (3, " ; "), (4, None), (5, "w5")], "qid int, text string")


def rows(df):
    return [(r.qid, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.orderBy("qid", "rank").collect()]


def test_rows_of_bm25_whatever_the_order_of_additions(spark, chunks, questions, tmp_path):
    index = TextIndex(spark, str(tmp_path / "t"), buckets=4)
    for some in (F.col("chunk_id") < 500, F.col("chunk_id").between(500, 800), F.col("chunk_id") > 800):
        index.add(chunks.filter(some), segment_rows=50)
    again = TextIndex(spark, str(tmp_path / "t"), buckets=4)
    assert again.counts()[0] == 1503
    for documents, k, first in ((None, 3, 1), ([2, 3], 8, 2), ([], 400, 4)):
        assert rows(again.search(questions, k, documents, first)) == rows(search.bm25(chunks, questions, k, documents))
    assert again.share_read(questions.filter("qid = 5"), 1, 2) < 0.3 and again.share_read(questions.filter("qid = 1"), 3, 2) < 1


def test_only_the_questions_folders_are_read(spark, chunks, questions, tmp_path):
    index = TextIndex(spark, str(tmp_path / "t"))
    index.add(chunks)
    asked = questions.filter("qid = 1").select("qid", F.explode(F.split(F.lower("text"), "[, ]+")).alias("term"))
    held = index.of_terms(asked)
    plan = held.select("term", "segment", "n")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1][:120]
    assert "In(term" in plan and "chunk_ids" not in plan.split("ReadSchema")[1]
    assert held.select("bucket").distinct().count() <= 3 and index.blocks().select("bucket").distinct().count() > 30


def test_bounds_hold_after_later_additions(spark, chunks, questions, tmp_path):
    """A block's bound is at least each of its chunks' parts, with counts and mean length as they are now."""
    index = TextIndex(spark, str(tmp_path / "t"), buckets=4)
    index.add(chunks.filter("chunk_id < 300"), segment_rows=40)
    index.add(spark.createDataFrame([(i, 1, "w0 " * 3000) for i in range(20_000, 20_050)], "chunk_id long, document_id long, content string"))
    asked = questions.filter("qid = 0").select("qid", F.explode(F.split("text", " ")).alias("term"))
    blocks, (n, mean) = index.of_terms(asked), index.counts()
    bounds = index._bounds(blocks, asked, n, mean)
    found = index._scores(blocks, bounds, bounds.select("qid", "segment").distinct(), n, mean, None)
    placed = blocks.select("segment", F.explode("chunk_ids").alias("chunk_id")).distinct()
    most = found.join(placed, "chunk_id").groupBy("segment").agg(F.max("score").alias("score")).join(bounds.groupBy("segment").agg(F.sum("bound").alias("bound")), "segment")
    assert most.count() > 5 and most.filter("score > bound + 1e-9").count() == 0


def test_empty(spark, questions, tmp_path):
    index = TextIndex(spark, str(tmp_path / "t"))
    assert index.counts() == (0, 0.0) and index.search(questions).count() == 0
    index.add(spark.createDataFrame([], "chunk_id long, document_id long, content string"))
    assert index.search(questions).count() == 0 and index.search(questions.limit(0)).count() == 0


def test_texts_are_cut_once_and_peaks_are_exact(spark, tmp_path):
    cut = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        cut.add(1)
        return text.lower().split()

    draw = random.Random(3)
    rows = [(no, no % 3 or None, " ".join(draw.choice(["ash", "bay", "Élan", "dew", "elm"]) for _ in range(draw.randrange(1, 30)))) for no in range(90)] + [(90, 1, None), (91, 2, " ")]
    index = TextIndex(spark, str(tmp_path / "index"), words, 3)
    index.add(spark.createDataFrame(rows, "chunk_id long, document_id long, content string").repartition(3), segment_rows=20)
    assert cut.value == len(rows)
    assert index.counts() == (92, sum(len((t or "").split()) for *_, t in rows) / 92)
    texts, seen = {no: (t or "").lower().split() for no, _, t in rows}, []
    for r in index.blocks().collect():
        postings = list(zip(r.tfs, r.dls, r.chunk_ids, r.document_ids, strict=True))
        assert r.n == len(postings) and all((tf, dl, d) == (texts[c].count(r.term), len(texts[c]), rows[c][1]) for tf, dl, c, d in postings)
        pairs = {(tf, dl) for tf, dl, *_ in postings}
        assert {(p.tf, p.dl) for p in r.peaks} == {p for p in pairs if not any(q != p and q[0] >= p[0] and q[1] <= p[1] for q in pairs)}
        seen += [(r.term, c) for c in r.chunk_ids]
    assert sorted(seen) == sorted((t, no) for no, ts in texts.items() for t in set(ts))
