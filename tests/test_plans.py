import asyncio
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lectern.plans import contracts, deep_search, ingest, runner
from lectern.plans.gateway import Gateway, embed_chunks, ordered_vectors, request_ends
from lectern.serve import cli
from lectern.sources import files
from lectern.streaming.arrivals import ingest_stream


def corpus(spark):
    rows = [(i, f"text about topic{i % 3} number {i}", 1 + i % 2, i, f"{1 + i % 2}.{i}", "References" if i == 4 else "H", [1.0, i / 10]) for i in range(8)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, document_id long, section_id long, path string, heading string, vector array<double>").selectExpr("*", "'Book' as title")
    sections = spark.createDataFrame([(i, 1 + i % 2, f"{1 + i % 2}.{i}", 2, "leaf") for i in range(8)] + [(100, 1, "1", 1, "chapter one"), (101, 2, "2", 1, "chapter two")], "section_id long, document_id long, path string, depth int, full_text string")
    return chunks, sections, spark.createDataFrame([(1, "Book"), (2, "Book")], "document_id long, title string"), spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "qid int, vector array<double>")


def searcher(spark, reflections, plan=None, **options):
    chunks, sections, titles, vectors = corpus(spark)
    model = deep_search.ScriptedModel(plan or {"sub_questions": ["q"], "vector_queries": ["v0"], "bm25_queries": ["topic1"]}, reflections, ["See ", "[Book › 2]", "."], vectors, spent=options.pop("spent", 0.0))
    return deep_search.DeepSearch(chunks, sections, titles, model, deep_search.Settings(top_k=3, **options))


MORE = {"is_sufficient": False, "gaps": ["g"], "new_bm25_queries": [" topic2 "]}


def test_events_in_order_and_result(spark):
    search = searcher(spark, [MORE, {"is_sufficient": True}])
    events = list(search.stream("What?"))
    assert [e.type for e in events] == ["plan_ready", "search_round", "reflect_result", "search_round", "reflect_result", "expand_ready", "answer_delta", "answer_delta", "answer_delta", "final"]
    final = events[-1].body
    assert final["answer"] == "See [Book › 2]." and final["citations"] == ["Book › 2"] and final["iterations"] == 2
    assert events[3].body["bm25_queries"] == ["topic2"] and events[3].body["total_chunks"] == events[1].body["new_chunks"] + events[3].body["new_chunks"]
    assert {b["section_id"] for b in final["blocks"]} <= {100, 101} and "final" not in final["trace"]
    assert "topic1" in search.model.asked[0]
    frames = [f for f in deep_search.sse(iter(events))]
    assert frames[0].startswith("event: plan_ready\ndata: {") and json.loads(frames[-1].split("data: ")[1])["answer"] == final["answer"]
    assert list(deep_search.coalesced(iter(events), 5)) == ["See [Book › 2]", "."]


@pytest.mark.parametrize(("reflections", "options", "rounds"), [([{"is_sufficient": True}], {}, 1), ([MORE], {"max_iterations": 1}, 1), ([{"is_sufficient": False}], {}, 1), ([MORE], {"cost_ceiling": 1.0, "spent": 2.0}, 1), ([dict(MORE, new_bm25_queries=["topic1"])], {}, 2)])
def test_every_way_out_of_the_loop(spark, reflections, options, rounds):
    assert searcher(spark, reflections, **options).run("What?")["iterations"] == rounds


def test_blank_question_and_nothing_found(spark):
    with pytest.raises(ValueError):
        searcher(spark, [MORE]).run("  ")
    got = searcher(spark, [{"is_sufficient": True}], plan={"sub_questions": ["q"], "bm25_queries": ["zebra"]}).run("What?")
    assert got["chunks"] == [] and got["blocks"] == [] and got["citations"] == []


def test_plans_are_checked():
    plan = contracts.parse_json(contracts.SearchPlan, '{"sub_questions": [" a ", ""], "vector_queries": [" v "]}')
    assert plan.sub_questions == ["a"] and plan.vector_queries == ["v"]
    for bad in ('{"sub_questions": ["  "], "vector_queries": ["v"]}', '{"sub_questions": ["a"]}', "[1]", "{", '{"sub_questions": ["a"], "other": 1}'):
        with pytest.raises(ValueError):
            contracts.parse_json(contracts.SearchPlan, bad)
    with pytest.raises(ValueError):
        contracts.parse_json(contracts.Reflection, '{"is_sufficient": "yes"}')
    assert deep_search.Settings().override(top_k=3, rrf_k=None) == deep_search.Settings(top_k=3)


def test_gateway_retries_orders_and_counts_cost():
    calls = []

    def flaky(model, messages):
        calls.append(model)
        if len(calls) < 3:
            raise OSError
        return "ok", 0.5

    costs = []
    g = Gateway({"plan": "m"}, complete=flaky, stream=lambda m, x: iter(["a", "", "b"]), embed=lambda m, t: [(1, [2.0]), (0, [1.0])], retries=2, dimension=1, on_cost=lambda *a: costs.append(a))
    assert g.completion("plan", []) == "ok" and len(calls) == 3 and g.cost == 0.5 and costs == [("plan", 0.5)]
    assert list(g.streaming("plan", [])) == ["a", "b"] and g.embedding("plan", ["x", "y"]) == [[1.0], [2.0]] and g.embedding("plan", []) == []
    with pytest.raises(KeyError):
        g.completion("clean", [])
    for found, dim in (([(0, [1.0])], None), ([(0, [1.0]), (1, [1.0])], 2)):
        with pytest.raises(ValueError):
            ordered_vectors(found, 2, dim)


def test_ingest_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/book.txt").write_text("Chapter 1: One\nSome words ,  here.\nChapter 2: Two\nOther words.\n")
    settings = ingest.IngestSettings(method="text", clean="normalize", chunk_size=2, overlap=0, dimension=2)
    ledger = runner.Ledger(spark, str(tmp_path), "run")
    make = lambda: ingest.stages(spark, str(tmp_path / "in"), "book", lambda texts: [(i, [float(len(t)), 1.0]) for i, t in enumerate(texts)], settings)
    ran = runner.run_in_order(make(), ledger)
    rows = spark.read.parquet(ran["04_embed"]).orderBy("section_path", "seq").collect()
    assert [(r.id, r.text, list(r.vector)) for r in rows] == [("book:1:0", "Some words,", [11.0, 1.0]), ("book:1:1", "here.", [5.0, 1.0]), ("book:2:0", "Other words.", [12.0, 1.0])]
    assert spark.read.parquet(ran["05_persist"]).first().asDict() == {"external_id": "book", "sections": 2, "chunks": 3}
    assert runner.run_in_order(make(), ledger) == {}
    with pytest.raises(ValueError):
        ingest.clean_sections(spark.read.parquet(ran["02_structure"]), "llm")
    with pytest.raises(ValueError):
        settings.checked()


def test_a_book_by_command(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "book.txt").write_text("Chapter 1: One\nSome words here.\n")
    (tmp_path / "own.toml").write_text('method = "text"\nchunk_size = 2\noverlap = 0\n')
    monkeypatch.setenv("LECTERN_INGEST_DIMENSION", "1536")
    monkeypatch.setattr(cli, "named", lambda path, option: lambda texts: [(i, [0.0] * 1536) for i, _ in enumerate(texts)])
    command = ["--ingest", str(tmp_path / "book.txt"), "--external-id", "b", "--embedder", "m:f", "--runs", str(tmp_path / "runs"), "--library", str(tmp_path / "lib"), "--config", str(tmp_path / "own.toml")]
    for _ in range(2):  # the second time nothing is left to do
        assert cli.main(command) == 0 and json.loads(capsys.readouterr().out) == {"external_id": "b", "sections": 1, "chunks": 2}
    with pytest.raises(SystemExit):
        cli.main(["--ingest", "x"])


def test_calls_of_an_event_loop_and_of_executors(spark):
    calls = []

    async def flaky(model, messages):
        calls.append(model)
        if len(calls) < 2:
            raise OSError
        return "ok", 0.5

    async def texts(model, messages):
        for t in ("a", "", "b"):
            yield t

    async def all_of():
        g = Gateway({"t": "m"}, complete=flaky, stream=texts, embed=lambda m, t: [(1, [2.0]), (0, [1.0])], retries=1)
        plain = Gateway({"t": "m"}, stream=lambda m, x: iter(["c", None]))
        return await g.acompletion("t", []), g.cost, await g.aembedding("t", ["x", "y"]), [t async for t in g.astreaming("t", [])], [t async for t in plain.astreaming("t", [])]

    assert asyncio.run(all_of()) == ("ok", 0.5, [[1.0], [2.0]], ["a", "b"], ["c"]) and len(calls) == 2
    seen = []

    def embed(texts):
        seen.append(len(texts))
        if len(seen) == 1:
            raise OSError
        return [(i, [float(len(t))]) for i, t in enumerate(texts)]

    rows = spark.createDataFrame([(str(i) * 3, 4) for i in range(2500)], "text string, token_count int").coalesce(1)
    assert embed_chunks(rows, embed, "m", 1, 10_000, 900, 1).agg(F.sum(F.col("vector")[0]), F.count("*")).first() is not None
    assert request_ends([4] * 10, 12, 5) == [3, 6, 9] and request_ends([50, 1, 1], 12, 5) == [1] and request_ends([1] * 7, 100, 3) == [3, 6]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\fy")
    (tmp_path / "b.txt").write_text(" \n\f ")
    assert files.read_text(spark, str(tmp_path / "a.txt")).first().text == "x\fy"
    assert files.extract(spark, str(tmp_path / "a.txt"), "text").first().text == "x\fy"
    with pytest.raises(Exception, match="no text in"):
        files.extract(spark, str(tmp_path / "b.txt"), "text").collect()
    for unknown in ("other", "PyPDF2"):
        with pytest.raises(files.ExtractError):
            files.backend(unknown)
    assert files.backend("pypdf2") is files.pypdf
    (tmp_path / "c.jsonl").write_text('{"external_id": "e", "seq": 1}\n\n{"external_id": "f"}\n')
    schema = contracts.CHUNK
    with pytest.raises(Exception, match="is missing"):
        files.read_jsonl(spark, str(tmp_path / "c.jsonl"), schema).collect()


def test_arrivals_are_upserted_once(spark, tmp_path):
    seen = []
    spark.range(5).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest_stream(spark, str(tmp_path / "in"), "id long", lambda df, n: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 5


def test_registry_has_sql_for_all_but_the_walk():
    names, sql = set(__spark_entry__.queries()), set(__spark_entry__.oracle_sql())
    own = {n for n in names if not n.startswith("op") or n == "opener_chapters"} - {"pipeline"}
    assert sql <= names and own - sql == {"deep_search_trace", "chunk_recursive", "ivf_topk"} and len(own) > 30
