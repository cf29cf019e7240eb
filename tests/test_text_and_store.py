import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import chunking, store


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("repli-\ncation", "replication"), ("a , b", "a, b"), ("( x ]", "(x]"), ("a  \t b", "a b"), ("a  \nb\t", "a\nb"), ("a\n\n\n\nb", "a\n\nb"), ("  [ é-\nà ] ,  z \n\n\n\n w", "[éà], z\n\n w"), ("", "")])
def test_cleaning(spark, raw, want):
    assert one(spark, raw, X.clean) == want


def test_headings_labels_and_snippets(spark):
    for text, want in (("Good Heading", True), ("no capital", False), ("1 Number", False), ("Ends here.", False), ("|", False), ("", False), (" ".join(["Word"] * 11), False)):
        assert one(spark, text, X.looks_like_heading) is want
    assert one(spark, "1.2.3  Title", X.is_numbered_heading) and not one(spark, "1.2 Title", X.is_numbered_heading)
    assert one(spark, " 1234 ", X.is_page_number) and not one(spark, "12345", X.is_page_number)
    assert one(spark, "a \n b " * 100, X.snippet) == ("a b " * 75).rstrip() + "…" and one(spark, " a\n b ", X.snippet) == "a b"
    assert one(spark, None, lambda t: X.source_label(t, F.lit("1.2"))) == "None › 1.2" and one(spark, "T", lambda t: X.source_label(t, F.lit(""))) == "T"


def test_identity(spark):
    row = spark.sql("SELECT 'b' e, '1.2' p, 3 s, 'text' t").select(X.chunk_key(F.col("e"), F.col("p"), F.col("s")).alias("k"), X.content_hash(X.chunk_key(F.col("e"), F.col("p"), F.col("s")), F.col("t")).alias("h")).first()
    assert row.k == "b:1.2:3" and row.h == hashlib.sha256(b"b:1.2:3\x00text").hexdigest()


def test_vectors_must_have_the_dimension(spark):
    df = spark.sql("SELECT array(1D, 2D) v").select(X.checked_vector(F.col("v"), 3))
    with pytest.raises(Exception, match="3 components"):
        df.collect()


def test_chunks_of_leaves(spark):
    words = [f"w{i}" for i in range(220)]
    schema = "external_id string, path string, heading string, is_leaf boolean, text string, page_range struct<lo:int,hi:int>, metadata map<string,string>"
    rows = [("b", "1", "C", False, "skip me", None, None), ("b", "1.1", "S", True, " ".join(words), (1, 2), {"a": "b"}), ("b", "1.2", "E", True, "  \n ", None, None), ("b", "x", "Odd", True, "one", None, None)]
    sections = spark.createDataFrame(rows, schema)
    plain = chunking.chunk(sections, lambda t: chunking.windows(t, 50, 0)).orderBy("section_path", "seq").collect()
    assert [r.token_count for r in plain] == [50, 50, 50, 50, 20, 1] and " ".join(r.text for r in plain[:5]).split() == words
    assert plain[0].chapter == 1 and plain[5].chapter is None and plain[0].metadata == {"a": "b"} and plain[0].id == "b:1.1:0"
    lapped = chunking.chunk(sections, lambda t: chunking.windows(t, 50, 10)).orderBy("section_path", "seq").collect()
    assert lapped[1].text.split() == words[40:100] and max(r.token_count for r in lapped) == 60
    own = chunking.chunk(sections, lambda t: F.array(F.lit(" "), F.lit("p"), F.lit("q"))).filter("section_path = '1.1'").collect()
    assert [(r.seq, r.text) for r in own] == [(0, "p"), (1, "q")]


def packed(sizes, tokens, items):
    out, batch, held, n = [], 0, 0, 0
    for s in sizes:
        if n and (held + s > tokens or n >= items):
            batch, held, n = batch + 1, 0, 0
        held, n = held + s, n + 1
        out.append(batch)
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=30))
def test_batches_equal_the_loop(spark, sizes):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, i int, token_count int")
    got = [r.batch for r in chunking.batches(df, "g", ["i"], 250, 3).orderBy("i").collect()]
    assert got == packed(sizes, 250, 3)


def test_upserts_are_idempotent(spark):
    stored = spark.sql("SELECT 7L document_id, 'a' external_id, 'A' title, 's' source, timestamp'2026-01-01' updated_at")
    arriving = spark.sql("SELECT * FROM VALUES ('a', 'X', 's'), ('c', 'C', 's'), ('b', 'B', 's'), ('b', 'B', 's') t(external_id, title, source)")
    now = F.lit("2026-02-02").cast("timestamp")
    once = store.upsert_documents(stored, arriving, now)
    assert sorted((r.document_id, r.external_id, r.title) for r in once.collect()) == [(7, "a", "A"), (8, "b", "B"), (9, "c", "C")]
    twice = store.upsert_documents(once, arriving, now)
    assert sorted(twice.collect()) == sorted(once.collect())
    rows = spark.sql("SELECT * FROM VALUES (1, 'h', 5), (1, 'h', 6), (1, cast(null as string), 7), (1, cast(null as string), 8) t(d, h, id)")
    assert sorted(r.id for r in store.insert_absent(rows.limit(0), rows, ["d", "h"], ["id"]).collect()) == [5, 7, 8]
    with pytest.raises(ValueError):
        store.one_document(arriving)


def test_chunks_are_placed(spark):
    docs = spark.sql("SELECT 7L document_id, 'b' external_id")
    sections = spark.sql("SELECT 7L document_id, 3L section_id, '1.1' path")
    chunks = spark.sql("SELECT * FROM VALUES ('b', '1.1', 1, 0, map('a', '1')), ('b', '9.9', 9, 0, map('embedding_model', 'old')), ('b', '1.1', 1, 1, cast(null as map<string,string>)) t(external_id, section_path, chapter, seq, metadata)")
    got = store.place_chunks(chunks, docs, sections, F.lit("m")).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.section_id, r.metadata) for r in got] == [(0, 3, {"a": "1", "embedding_model": "m"}), (1, 3, {"embedding_model": "m"}), (2, None, {"embedding_model": "m"})]


def test_parents_are_linked(spark):
    rows = spark.sql("SELECT * FROM VALUES (1L, 1L, '1', cast(null as string)), (2L, 1L, '1.1', '1'), (3L, 2L, '1.1', '1') t(section_id, document_id, path, parent_path)")
    assert {r.section_id: r.parent_id for r in store.link_parents(rows).collect()} == {1: None, 2: 1, 3: None}


@pytest.mark.parametrize("raw", [" \x1f a \x1d", "a\x1cb\x85c", "\u3000x\x1e\n y\u2009", "\x1f"])
def test_white_space_is_that_of_split(spark, raw):
    got = spark.createDataFrame([(raw,)], "t string").select(X.count_words(F.col("t")).alias("n"), X.strip(F.col("t")).alias("s"), X.snippet(F.col("t")).alias("f"), chunking.windows(F.col("t"), 2, 0).alias("w")).first()
    assert (got.n, got.s, got.f) == (len(raw.split()), raw.strip(), " ".join(raw.split())) and " ".join(got.w).split() == raw.split()


def test_ranges_are_numbered_in_order(spark):
    rows = spark.createDataFrame([(f"k{i:04d}",) for i in range(500)], "external_id string").repartition(7)
    assert [r.external_id for r in store.numbered_by(rows, "external_id").orderBy("n").collect()] == [f"k{i:04d}" for i in range(500)]
    assert store.numbered_by(rows.limit(0), "external_id").count() == 0
