import asyncio
import threading
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import search
from lectern.plans import deep_search, tagged
from lectern.serve import agent


def tables(spark):
    chunks = spark.createDataFrame([(i, f"red fish {i}", 1, 1, "Book", "1", "H", [1.0, float(i)]) for i in range(6)], "chunk_id long, content string, document_id long, section_id long, title string, path string, heading string, vector array<double>")
    sections = spark.createDataFrame([(1, 1, "1", 1, "whole")], "section_id long, document_id long, path string, depth int, full_text string")
    return chunks, sections, spark.createDataFrame([(1, "Book")], "document_id long, title string")


def model(spark, **plan):
    vectors = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, vector array<double>")
    return deep_search.ScriptedModel({"sub_questions": ["q"], "vector_queries": ["v0"], "bm25_queries": ["fish"]} | plan, [{"is_sufficient": True}], ["In [Book › 1]."], vectors)


def slow(spark, seconds=60):
    """Chunks that take long to read."""
    chunks, sections, titles = tables(spark)

    @F.udf("string")
    def wait(text):
        time.sleep(seconds)
        return text

    return chunks.withColumn("content", wait("content")), sections, titles


def running(spark, tag):
    return len(spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(tag)) and [j for j in spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(tag) if str(spark.sparkContext._jsc.sc().statusTracker().getJobInfo(j).get().status()) == "RUNNING"]


def until(test, seconds=30):
    end = time.time() + seconds
    while time.time() < end:
        if test():
            return True
        time.sleep(0.1)
    return False


def test_both_searches_of_a_round_run_at_once(spark, monkeypatch):
    both = threading.Barrier(2, timeout=60)
    for name in ("knn", "bm25"):
        real = getattr(search, name)
        monkeypatch.setattr(search, name, lambda *a, real=real, **b: both.wait() is not None and real(*a, **b))
    got = deep_search.DeepSearch(*tables(spark), model(spark)).run("Which fish?")
    assert got["citations"] == ["Book › 1"] and len(got["chunks"]) == 6


def test_jobs_carry_the_tag_and_a_reader_that_leaves_ends_them(spark):
    own = deep_search.DeepSearch(*slow(spark), model(spark))
    events, told = own.stream("Which fish?", tag="reader"), []
    assert next(events).type == "plan_ready" and "reader" not in spark.sparkContext.getJobTags()
    reading = threading.Thread(target=lambda: told.append(pytest.raises(Exception, lambda: next(events))))
    reading.start()
    assert until(lambda: running(spark, "reader"))
    own.cancel("reader")
    reading.join(30)
    assert not reading.is_alive() and told and until(lambda: not running(spark, "reader"))
    assert spark.range(10).count() == 10


def test_a_cancelled_event_loop_task_leaves_no_job(spark):
    own = deep_search.DeepSearch(*slow(spark), model(spark))

    async def ask():
        reading = asyncio.create_task(own.arun("Which fish?", tag="loop"))
        assert await asyncio.to_thread(until, lambda: running(spark, "loop"))
        reading.cancel()
        with pytest.raises(asyncio.CancelledError):
            await reading

    asyncio.run(ask())
    assert until(lambda: not running(spark, "loop"))
    quick = deep_search.DeepSearch(*tables(spark), model(spark))
    assert asyncio.run(quick.arun("Which fish?")) == quick.run("Which fish?")


def test_a_cancelled_agent_task_leaves_no_job(spark):
    server = agent.Agent(deep_search.DeepSearch(*slow(spark), model(spark)))
    request = {"jsonrpc": "2.0", "id": 1, "method": "message/stream", "params": {"message": {"parts": [{"kind": "text", "text": "Which fish?"}]}}}
    answers, rest = server.answer(request), []
    task = next(answers)["result"]
    reading = threading.Thread(target=lambda: rest.extend(answers))
    reading.start()
    assert until(lambda: running(spark, task["id"]))
    assert list(server.answer({"jsonrpc": "2.0", "id": 2, "method": "tasks/cancel", "params": {"id": task["id"]}}))[0]["result"]["status"]["state"] == "failed"
    reading.join(30)
    assert not reading.is_alive() and rest[-1]["result"]["status"]["state"] == "failed" and until(lambda: not running(spark, task["id"]))


def test_tags_are_taken_off_and_errors_end_the_other_call(spark):
    with tagged.tagged(spark, "outer"):
        with tagged.tagged(spark, "outer"):
            pass
        assert "outer" in spark.sparkContext.getJobTags()
    assert "outer" not in spark.sparkContext.getJobTags()

    def fails():
        assert until(lambda: running(spark, "pair"))
        raise OSError("one")

    began = time.time()
    with pytest.raises(OSError, match="one"):
        tagged.at_once(spark, "pair", [fails, lambda: slow(spark)[0].agg(F.max("content")).collect()])
    assert time.time() - began < 50
