import pytest

from lectern.plans import contracts, deep_search
from lectern.plans.library import Library
from lectern.plans.settings import ModelSettings, gateway_of, ingest_models, load, query_models
from lectern.sources import tables
from tests.test_library import tables as given


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("provider") / "lib")
    Library(spark, base, buckets=2).persist(*given(spark, [("1.1", "red fish"), ("7", "blue fish")]))
    return base


def answer(spark, provider):
    vectors = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, vector array<double>")
    model = deep_search.ScriptedModel({"sub_questions": ["q"], "vector_queries": ["v0"], "bm25_queries": ["fish"]}, [{"is_sufficient": True}], ["In [Book › 1]."], vectors)
    return deep_search.DeepSearch(*tables.search_tables(provider), model).run("Which fish?")


def test_a_folder_and_a_catalog_give_the_same_answer(spark, folder):
    from_folder = answer(spark, tables.connect(spark, folder)())
    spark.sql("CREATE DATABASE IF NOT EXISTS books")
    contracts.create_tables(spark, "books")
    for name in tables.COLUMNS:
        spark.read.parquet(f"{folder}/{name}").write.insertInto(f"books.{name}", overwrite=True)
    assert answer(spark, tables.connect(spark, "catalog:books")()) == from_folder
    assert {c["content"] for c in from_folder["chunks"]} == {"red fish", "blue fish"} and from_folder["citations"] == ["Book › 1"]


def test_tables_that_lack_something(spark, folder, tmp_path):
    provider = tables.connect(spark, str(tmp_path))()
    with pytest.raises(tables.NoTable, match="no table 'pages'"):
        provider("pages")
    spark.createDataFrame([(1,)], "chunk_id long").write.parquet(f"{tmp_path}/chunks")
    with pytest.raises(tables.NoTable, match="document_id, section_id, content, embedding"):
        provider("chunks")
    spark.createDataFrame([(1, "T", "x")], "document_id int, title string, colour string").write.parquet(f"{tmp_path}/documents")
    assert provider("documents").first().asDict() == dict.fromkeys(spark.createDataFrame([], contracts.DOCUMENTS_TABLE).columns) | {"document_id": 1, "title": "T"}


def test_models_of_tasks(tmp_path):
    (tmp_path / "s.toml").write_text('default = "small"\nplan = "large"\ndimension = 3\n')
    s = load(ModelSettings, str(tmp_path / "s.toml"), environ={"LECTERN_EMBED": "vectors", "LECTERN_RETRIES": "1"})
    assert ingest_models(s) == {"embed": "vectors", "default": "small"}
    assert query_models(s) == {"plan": "large", "reflect": "small", "synth": "small", "embed": "vectors"}
    seen = []

    def embed(model, texts):
        seen.append(model)
        return [(i, [1.0, 2.0, 3.0]) for i in range(len(texts))] if len(seen) > 1 else [][0]

    gateway = gateway_of(s, query_models(s), embed=embed)
    assert gateway.embedding("embed", ["a", "b"]) == [[1.0, 2.0, 3.0]] * 2 and seen == ["vectors", "vectors"]
    with pytest.raises(KeyError):
        gateway.model("default")
    for bad in ({"embed": " "}, {"retries": -1}, {"dimension": 0}):
        with pytest.raises(ValueError):
            ModelSettings(**bad)
