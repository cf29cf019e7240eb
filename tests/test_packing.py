import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import blocks, chunking, packing


def greedy(weights, limit, most):
    out, run, total, items = [], 0, 0, 0
    for w in weights:
        if items and (total + w > limit or items >= most):
            run, total, items = run + 1, 0, 0
        out.append(run)
        total, items = total + w, items + 1
    return out


def frames(texts, limit):
    out, held = [], ""
    for t in texts:
        held += t
        if len(held) >= limit:
            out.append(held)
            held = ""
    return out + [held] * bool(held)


@pytest.mark.parametrize("block", [packing.BLOCK, 24])
def test_batches_of_any_group_equal_the_greedy_walk(spark, monkeypatch, block):
    """Groups of no more than a block, and groups over many blocks, whose entries come from joined tables."""
    draw = random.Random(block)
    sizes = {"one": 1, "big": 3000, None: 700, "mid": 90, "": 24, "x": 25, "y": 48}
    weights = {g: [draw.choice([0, 1, 5, 9, 30, 200]) for _ in range(n)] for g, n in sizes.items()}
    rows = [(g, i // 10, i % 10, w) for g, ws in weights.items() for i, w in enumerate(ws)]
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "external_id string, section int, seq int, token_count int").repartition(5)
    got = packing.runs(table, "external_id", ["section", "seq"], F.col("token_count"), 40, 3, block=block)
    assert got.columns == [*table.columns, "run"]
    found = {(r.external_id, r.section * 10 + r.seq): r.run for r in got.collect()}
    assert found == {(g, i): n for g, ws in weights.items() for i, n in enumerate(greedy(ws, 40, 3))}
    batch = chunking.batches(table, "external_id", ["section", "seq"], 40, 3)
    assert batch.schema["batch"].dataType.simpleString() == "int" and {(r.external_id, r.section * 10 + r.seq): r.batch for r in batch.collect()} == found


def test_null_counts_and_no_rows(spark):
    table = spark.createDataFrame([("a", i, None if i % 2 else 3) for i in range(6)], "g string, i int, token_count int")
    assert [r.batch for r in chunking.batches(table, "g", ["i"], 5, 9).orderBy("i").collect()] == [0, 0, 1, 1, 2, 2]
    assert chunking.batches(table.limit(0), "g", ["i"]).count() == 0


@pytest.mark.parametrize("block", [packing.BLOCK, 40])
def test_frames_equal_what_a_reader_gets(spark, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    monkeypatch.setattr(packing.runs, "__defaults__", (False, block))
    draw = random.Random(4)
    texts = {q: [draw.choice(["", "a", "bc é", "🙂" * 4, "word " * 3]) for _ in range(n)] for q, n in ((1, 0), (2, 1), (3, 9), (4, 2000), (5, 300))}
    rows = [(q, i, t) for q, ts in texts.items() for i, t in enumerate(ts)] + [(6, 0, None), (6, 1, "only")]
    got = blocks.delta_frames(spark.createDataFrame(rows, "qid int, seq int, text string").repartition(4), 5)
    want = {q: frames(ts, 5) for q, ts in texts.items()} | {6: ["only"]}
    assert {(r.qid, r.frame_no): r.frame for r in got.collect()} == {(q, i + 1): f for q, fs in want.items() for i, f in enumerate(fs)}


def test_jumps_stay_in_their_stretch():
    weights, ends = np.array([3, 3, 3, 9, 1]), np.array([3, 3, 3, 5, 5])
    assert packing.following(weights, ends, 6, 2, False).tolist() == [2, 3, 3, 4, 5]
    assert packing.following(weights, ends, 6, 9, True).tolist() == [2, 3, 3, 4, 5]
    assert packing.reached(np.array([2, 3, 5, 4, 5]), np.array([0, 3])).tolist() == [True, False, True, True, True]


def test_texts_of_frames_are_exchanged_once(spark):
    """Groups of a block or fewer, larger ones, a null one and empty texts, against a plain loop; no group is larger: one exchange."""
    draw, rows, want = random.Random(4), [], []
    for qid in [*range(40), None]:
        held, no = "", 0
        for seq in range(draw.choice([1, 3, 30, 90])):
            text = draw.choice(["", None, "é", "ab", "c" * draw.randrange(1, 12)])
            rows.append((qid, seq, text))
            held += text or ""
            if len(held) >= 7:
                want.append((qid, no, held))
                held, no = "", no + 1
        if held:
            want.append((qid, no, held))
    draw.shuffle(rows)
    deltas = spark.createDataFrame(rows, "qid long, seq int, text string").repartition(5)
    for block in (20, 1000):
        got = packing.joined(deltas, "qid", ["seq"], 7, block)
        assert sorted(map(tuple, got.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])) == sorted(want, key=lambda x: (x[0] is None, x[0] or 0, x[1])), block
    plan = blocks.delta_frames(deltas, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") == 1
