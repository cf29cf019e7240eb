import pytest
from pyspark.sql import functions as F

from lectern.plans import deep_search, ingest, library, runner
from lectern.plans.library import IdCollision, Library

BOOK = "Chapter 1: One\nSome words here.\nChapter 2: Two\nOther words.\n"
SECTION = "external_id string, path string, depth int, parent_path string, ordinal int, heading string, is_leaf boolean, text string, token_count int"
CHUNK = "external_id string, section_path string, chapter int, seq int, text string, token_count int, metadata map<string,string>, id string, content_hash string, vector array<float>, embedding_model string"


def tables(spark, texts, book="b"):
    documents = spark.createDataFrame([(book, "Book", "file")], "external_id string, title string, source string")
    sections = [(book, "1", 1, None, 1, "One", False, "whole", 1), (book, "1.1", 2, "1", 1, "Part", True, "part", 1), (book, "1.1", 2, "1", 2, "Again", True, "again", 1), (book, "9.9", 2, "9", 1, "Lost", True, "lost", 1)]
    chunks = [(book, path, 1, i, t, 1, {"k": "v"}, f"{book}:{path}:{i}", f"h-{book}-{t}", [1.0, float(i)], "m") for i, (path, t) in enumerate(texts)]
    return documents, spark.createDataFrame(sections, SECTION), spark.createDataFrame(chunks, CHUNK)


def stamp(n):
    return F.lit(f"2026-01-0{n} 00:00:00").cast("timestamp")


def test_persisting_twice_adds_nothing(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"), buckets=4)
    given = tables(spark, [("1.1", "a"), ("1.1", "b"), ("7", "c"), ("1.1", "a")])
    for n in (1, 2):
        got = Library(spark, str(tmp_path / "lib"), buckets=4).persist(*given, now=stamp(n)).first()
        assert (got.external_id, got.sections, got.chunks) == ("b", 4, 4)
        assert library.sections().count() == 3 and library.chunks().count() == 3
    doc = library.documents().collect()
    assert len(doc) == 1 and doc[0].title == "Book" and doc[0].created_at.day == 1 and doc[0].updated_at.day == 2
    sections = {r.path: r for r in library.sections().collect()}
    assert sections["1.1"].parent_id == sections["1"].section_id and sections["1"].parent_id is None and sections["9.9"].parent_id is None
    assert sections["1.1"].heading == "Part" and sections["1"].full_text == "whole"
    chunks = {r.content: r for r in library.chunks().collect()}
    assert chunks["a"].section_id == sections["1.1"].section_id and chunks["c"].section_id is None and chunks["a"].chunk_index == 0
    assert chunks["b"].metadata == {"k": "v", "embedding_model": "m"} and list(chunks["b"].embedding) == [1.0, 1.0]
    library.persist(*tables(spark, [("1.1", "d")], "other"), now=stamp(3))
    assert library.documents().count() == 2 and library.chunks().count() == 4 and library.sections().count() == 6
    found, blocks, titles = library.search_tables()
    assert found.filter("section_id is null").first().path is None and blocks.count() == 6 and titles.count() == 2


def test_an_upsert_leaves_the_stored_side_in_its_buckets(spark, tmp_path):
    """With no table small enough to be broadcast, only what arrives is exchanged."""
    library = Library(spark, str(tmp_path / "lib"), buckets=8)
    documents, sections, chunks = tables(spark, [("1.1", "a")])
    library.persist(documents, sections, chunks)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        given = sections.select(F.xxhash64("external_id").alias("document_id"), "path", "parent_path", "ordinal", "text", F.lit(7).cast("long").alias("section_id"))
        for rows in (library_absent(library, given), library._with_parents(given)):
            plan = rows._jdf.queryExecution().executedPlan().toString().split("\n")
            scan = next(i for i, line in enumerate(plan) if "Bucketed: true" in line)
            between = "".join(plan[scan - 3 : scan])  # from the join's sort down to the scan
            assert "Sort" in between and "Filter" in between and "Exchange" not in between
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def library_absent(lib, given):
    from lectern.operators.store import absent

    return absent(lib.sections(), given, ["document_id", "path"], ["ordinal", "text"]).select("path")


def test_an_id_of_two_keys_is_an_error(spark, tmp_path, monkeypatch):
    lib = Library(spark, str(tmp_path / "lib"), buckets=2)
    lib.persist(*tables(spark, [("1.1", "a")]))
    monkeypatch.setattr(library, "hashed", lambda *keys: F.lit(5).cast("long") if keys == ("id",) else F.xxhash64(*keys))
    with pytest.raises(IdCollision, match="chunks"):
        lib.persist(*tables(spark, [("1.1", "b"), ("1.1", "c")]))
    lib.persist(*tables(spark, [("1.1", "b")]))
    with pytest.raises(IdCollision, match="chunks"):
        lib.persist(*tables(spark, [("1.1", "d")]))
    monkeypatch.setattr(library, "hashed", lambda *keys: F.lit(9).cast("long") if keys == ("external_id",) else F.xxhash64(*keys))
    with pytest.raises(IdCollision, match="documents"):
        lib.persist(*tables(spark, [("1.1", "x")], "one"))
        lib.persist(*tables(spark, [("1.1", "x")], "two"))
    assert lib.chunks().count() == 3  # a, b and the one that came before the collision


def test_indexes_take_in_what_arrives(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), buckets=2)
    lib.persist(*tables(spark, [("1.1", "red fish"), ("1.1", "blue fish")]))
    assert lib.vector_index() is None and lib.text_index() is None
    lib.make_indexes(cells=1)
    lib.persist(*tables(spark, [("1.1", "one more fish"), ("1.1", "red fish")], "other"))
    lib.persist(*tables(spark, [("1.1", "one more fish")], "other"))
    again = Library(spark, str(tmp_path / "lib"), buckets=2)
    asked = spark.createDataFrame([(0, "fish")], "qid int, text string")
    assert again.text_index().counts()[0] == again.vector_index().rows().count() == again.chunks().count() == 4
    assert again.text_index().search(asked).count() == 4
    vectors = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, vector array<double>")
    model = deep_search.ScriptedModel({"sub_questions": ["q"], "vector_queries": ["v0"], "bm25_queries": ["more"]}, [{"is_sufficient": True}], ["In [Book › 1]."], vectors)
    plain = deep_search.DeepSearch(*again.search_tables(), model).run("Which fish?")
    model.asked.clear()
    indexed = deep_search.DeepSearch(*again.search_tables(), model, vectors=again.vector_index(), texts=again.text_index()).run("Which fish?")
    assert indexed == plain and "one more fish" in {c["content"] for c in indexed["chunks"]}


def test_empty_tables(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"))
    assert library.documents().count() == 0 and all(t.count() == 0 for t in library.search_tables())
    assert library.persist(*(t.limit(0) for t in tables(spark, [("1", "a")]))).count() == 0 and library.chunks().count() == 0


def test_from_files_to_an_answer(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/book.txt").write_text(BOOK)
    settings = ingest.IngestSettings(method="text", chunk_size=2, overlap=0, dimension=2)
    embed = lambda texts: [(i, [float(len(t)), 1.0]) for i, t in enumerate(texts)]
    runner.run_in_order(ingest.stages(spark, str(tmp_path / "in"), "book", embed, settings, library=str(tmp_path / "lib"), title="Book"), runner.Ledger(spark, str(tmp_path), "run"))
    chunks, sections, titles = Library(spark, str(tmp_path / "lib")).search_tables()
    assert sorted(r.content for r in chunks.collect()) == ["Other words.", "Some words", "here."]
    vectors = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, vector array<double>")
    model = deep_search.ScriptedModel({"sub_questions": ["q"], "vector_queries": ["v0"], "bm25_queries": ["other"]}, [{"is_sufficient": True}], ["In [Book › 2]."], vectors)
    got = deep_search.DeepSearch(chunks, sections, titles, model).run("Which words?")
    assert got["citations"] == ["Book › 2"] and got["chunks"][0]["content"] == "Other words."
    assert {b["full_text"] for b in got["blocks"]} == {"Some words here.", "Other words."}
