import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.plans.answers import AnswerStore, Purse, bought
from lectern.plans.gateway import embed_chunks


def asked(folder):
    """An embedder that notes every text it is asked for in a file, as executors share no memory."""

    def embed(texts):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))]

    return embed


def notes(folder):
    return sorted(line for f in folder.iterdir() for line in f.read_text().split("\n"))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "notes").mkdir()
    return tmp_path / "notes"


def chunks(spark, texts):
    return spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in enumerate(texts)], "n int, text string, token_count int").repartition(3)


def test_no_text_is_asked_for_twice(spark, tmp_path, folder):
    store, told = AnswerStore(spark, str(tmp_path / "store")), []
    texts = [f"text {i % 7}" for i in range(40)] + ["", None]
    got = embed_chunks(chunks(spark, texts), asked(folder), "m", 2, max_tokens=13, store=store, price=0.5, on_paid=told.append)
    assert got.columns == ["n", "text", "token_count", "vector", "embedding_model"]
    assert {(r.n, tuple(r.vector), r.embedding_model) for r in got.collect()} == {(i, (float(len(t or "")), 1.0), "m") for i, t in enumerate(texts)}
    assert notes(folder) == sorted({t or "" for t in texts})
    more = embed_chunks(chunks(spark, [*texts, "new"]), asked(folder), "m", 2, store=AnswerStore(spark, str(tmp_path / "store")), on_paid=told.append)
    assert more.count() == 43 and notes(folder) == sorted({*(t or "" for t in texts), "new"})
    assert told[0]["texts"] == 8 and told[0]["tokens"] == 42 and told[0]["cost"] == 21.0 and told[0]["calls"] >= 4 and told[1]["texts"] == told[1]["calls"] == 1
    embed_chunks(chunks(spark, ["new"]), asked(folder), "other", 2, store=store, on_paid=told.append)
    assert told[2]["texts"] == 1 and store.totals("m")["texts"] == 9 and store.totals("other")["texts"] == 1


def test_a_run_after_one_that_failed_asks_only_for_the_rest(spark, tmp_path, folder):
    store, embed = AnswerStore(spark, str(tmp_path / "store")), asked(folder)

    def fails(texts):
        if "text 5" in texts:
            raise OSError("provider is down")
        return embed(texts)

    rows = chunks(spark, [f"text {i}" for i in range(6)]).coalesce(1).orderBy("n")
    with pytest.raises(Exception, match="provider is down"):
        embed_chunks(rows, fails, "m", 2, max_items=1, store=store)
    paid = notes(folder)
    told = []
    assert embed_chunks(rows, embed, "m", 2, max_items=1, store=store, on_paid=told.append).count() == 6
    assert notes(folder) == [f"text {i}" for i in range(6)] and told[0]["calls"] == 6 - len(paid) and store.totals("m")["calls"] == 6


def test_a_task_that_is_tried_again_reads_what_its_run_has_paid(tmp_path):
    calls, rows = [], pd.DataFrame({"key": list("abcdef"), "text": list("abcdef"), "token_count": [1] * 6})

    def embed(texts):
        calls.append(texts)
        if len(calls) == 3:
            raise OSError("lost")
        return [(i, [1.0]) for i in range(len(texts))]

    def tried(run, attempt, retries=0):
        return list(bought([rows[:3], rows[3:]], Purse(str(tmp_path / run), 0, attempt), embed, "m", 1, 100, 2, retries, 0.1))

    with pytest.raises(OSError):
        tried("run", 1)
    told = pd.concat(tried("run", 2))
    assert calls == [["a", "b"], ["c", "d"], ["e", "f"], ["e", "f"]]
    assert told["texts"].sum() == 6 and told["calls"].sum() == 3 and round(told["cost"].sum(), 6) == 0.6
    calls[:] = [[], []]
    told = pd.concat(tried("other", 1, retries=1))
    assert told["calls"].sum() == 4 and told["retries"].sum() == 1


def test_no_rows(spark, tmp_path, folder):
    store = AnswerStore(spark, str(tmp_path / "store"))
    assert embed_chunks(chunks(spark, ["x"]).limit(0), asked(folder), "m", 2, store=store).count() == 0 and store.totals("m")["calls"] == 0 and not notes(folder)
    assert store.known("m").select(F.count("*")).first()[0] == 0
