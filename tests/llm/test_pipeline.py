"""The pipeline on a small table against its stages' own decisions."""

import random
from collections import Counter

import corpus_pipeline
from lectern.llm import bpe, mixing, quality, simhash, toxicity


def test_pipeline_equals_its_stages(spark, tmp_path):
    draw = random.Random(11)
    rows, labels = [], []
    for i in range(300):
        toxic, bad = i % 7 == 0, i % 5 == 0
        words = [draw.choice("lorem ipsum dolor sit amet elit sed do tempor magna".split()) + str(draw.randrange(90)) + "q" for _ in range(draw.randrange(30, 80))]
        if toxic:
            words[3] = words[9] = "vileworm"
        text = " ".join(w + "##" if bad else w for w in words)
        rows.append((i, text, "en", draw.choice(["a", "b", None]), len(text)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "a", 1) for i in range(0, 300, 3)] + [(2000, None, None, None, None), (2001, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    verdicts = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, marks).collect()}
    left = docs.filter(docs.doc_id.isin([i for i, p in verdicts.items() if not p]))
    kept = {r.doc_id for r in quality.judge_quality(left, marks).collect() if r.kept}
    left = left.filter(left.doc_id.isin(list(kept)))
    firsts = {r.component_id for r in simhash.near_duplicates(left).collect()}
    left = left.filter(left.doc_id.isin(list(firsts)))
    copies = {r.doc_id: r.taken // r["size"] for r in mixing.mix(left).collect()}
    shas = {r.doc_id: r.ids_sha256 for r in bpe.encode_documents(left).collect()}
    assert got == Counter({(i, shas[i]): n for i, n in copies.items() if n})
    assert not any(verdicts[i] for i, _ in got) and sum(got.values()) > 100


def test_stages_return_the_columns_of_documents(spark, documents, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, str(tmp_path)).columns == documents.columns
        assert stage(spark, documents.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, documents.limit(0), str(tmp_path)).count() == 0
